import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tolmark.llm import token_count as C


def library(pieces):
    t = Tokenizer(models.Unigram([("\x00unknown\x00", 0.0), *pieces], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=C.MARK, prepend_scheme="always", split=True)
    return t


def test_equals_library_on_full_vocabulary():
    t, c = library(C.vocabulary()), C.counter(C.VOCABULARY)
    r = random.Random(2)
    texts = ["", " ", "a", " a", "a  b ", "x\ny", "\n", "\n\n z", "▁a▁", "☃é🙂☃ ☃", "Ärger, été́", "<unk><0x41></s>", "thernd" * 2000]
    texts += ["".join(r.choice(["th", "e", " ", "ing", "\n", "é", "Q", "tion", "☃", "1"]) for _ in range(r.randint(1, 80))) for _ in range(800)]
    for x in texts:
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), x[:50]


@pytest.mark.parametrize("seed", range(25))
def test_ties(seed):
    r = random.Random(seed)
    pieces = {"".join(r.choice("ab" + C.MARK * (k == 0)) for k in range(r.randint(1, 4))): float(-r.randint(0, 3)) for _ in range(14)}
    pieces = {p: s for p, s in pieces.items() if C.MARK not in p.lstrip(C.MARK)} | {f"<0x{b:02X}>": 0.0 for b in range(256)}
    t, c = library(list(pieces.items())), C.Counter(list(pieces.items()))
    for _ in range(200):
        x = "".join(r.choice("aabbc \n") for _ in range(r.randint(0, 14)))
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_rows(spark):
    rows = [(1, "the same"), (1, "the same"), (None, "x"), (2, None), (3, ""), (4, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS key", "'v' AS value")
    got = C.count_tokens(df, "doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, C.counter(C.VOCABULARY).count(t)) for d, t in rows), key=str)
    assert C.count_tokens(df.limit(0), "doc_id", "text").count() == 0
