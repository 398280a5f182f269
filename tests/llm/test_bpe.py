import copy
import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tolmark.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
BASE = bpe.TreeBPE()


def coder(block=None):
    """As TreeBPE(block=block), without reading the file again."""
    c = copy.copy(BASE)
    c.block, c.piece_block = block or bpe.BLOCK, block or bpe.PIECE_BLOCK
    c.forget()
    return c


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts():
    r = random.Random(1)
    out = ["", " ", "\n", "a", "It's 2024!!", "<|endoftext|>x<|startoftext|> <|end", "É\u0301té ΣΑΣ İstanbul", "a\x1cb\x1d \x85c\u2003d", "☃☃🙂e\u0301", "don't we'll they'd I'M", "\u200bx\u00a0y", "ab\x00c"]
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeé☃", "!?.", "thernd"):
        for n in (3, 255, 256, 257, 600, 3000):
            out.append("".join(r.choice(letters) for _ in range(n)))
    out += ["a" * 5000, "ha" * 2500, "word " * 300 + "x" * 1000 + " end"]
    return out


def test_tree_equals_library():
    c = coder(block=32)
    for t in texts():
        assert c.encode(t) == expected(t), t[:60]
        ids, decoded, n = c.both(t)
        assert ids == " ".join(map(str, expected(t))) and n == len(expected(t))
        assert decoded == LIBRARY.decode(expected(t), skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(40))
def test_joins_anywhere(seed):
    r = random.Random(seed)
    piece = "".join(r.choice(["the", "ing", "er", "a", "z", "tion", "q"]) for _ in range(200))
    c = coder(block=r.randint(2, 40))
    assert c.tree(piece) == expected(piece)


@pytest.mark.parametrize("seed", range(60))
def test_text_joins_anywhere(seed):
    r = random.Random(seed)
    parts = ["the", "'", "'s", "'ll", "l", "ve", " ", "\n", "\u00a0", "É", "ß", "7", "!?", "don't", "ing", "x" * 40, "字字字", "Ж", "\0", "\0\0", "☃", "e\u0301", "Σ", "\x1d", "<|endoftext|>", "<|"]
    c = coder(block=r.randint(1, 24))
    for n in (5, 40, 400):
        text = "".join(r.choice(parts) for _ in range(n))
        assert c.encode(text) == expected(text)
        plain = "".join(r.choice(parts[:15]) for _ in range(n))  # the known alphabet, hence one tree
        assert c.encode(plain) == expected(plain)


def test_long_unsplit_texts(monkeypatch):
    r = random.Random(5)
    c = coder()
    joins = []
    own = bpe.join_halves
    monkeypatch.setattr(bpe, "join_halves", lambda *a: joins.append(1) or own(*a))
    for text in ("".join(r.choice("etaoinshr") for _ in range(60_000)), "é" * 9000, "漢字かな" * 3000, "?!" * 8000):
        assert c.encode(text) == expected(text)
        assert joins
        joins.clear()


def test_segments(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    c, r = coder(block=16), random.Random(9)
    for n in (10, 80, 500):
        text = "".join(r.choice(["word ", "it's", "\n", "é", "☃ ", "y" * 30, " "]) for _ in range(n))
        assert c.encode(text) == expected(text)


def test_data_goes_through_the_tree(spark):
    """Texts of more than a block, as nearly all documents are, are joined from halves."""
    c, joins = coder(), []
    text = "the thing is that it isn't unsplit, Straße 7. " * 200
    own = bpe.join_pieces
    bpe.join_pieces = lambda *a: joins.append(1) or own(*a)
    try:
        assert c.encode(text) == expected(text) and len(joins) == -(-len(text) // bpe.BLOCK) - 1
    finally:
        bpe.join_pieces = own


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.TreeBPE(bpe.public_tokenizers.path("byte_bpe_50k.json"))


def test_query_columns(spark):
    rows = [(1, "Hello there"), (2, None), (2, None), (None, "x"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", bpe.F.lit("clash")).withColumn("key", bpe.F.lit(1)).withColumn("value", bpe.F.lit(2))
    got = sorted(map(tuple, bpe.encode_digest(df, "doc_id", "text").collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted([(k, len(expected(t)), sha(" ".join(map(str, expected(t)))), sha(LIBRARY.decode(expected(t), skip_special_tokens=False))) for k, t in rows], key=str)
    assert got == want
    assert bpe.encode_digest(df.limit(0), "doc_id", "text").count() == 0
    back = bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id").collect()
    assert back[0].text == "hello</w> there</w>"
