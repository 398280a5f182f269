"""Each stage on its own input, against plain Python."""

import re

import numpy as np
import pytest
from test_line_dedup import expected as lines_by_hand
from test_near_dup import expected as groups_by_hand
from test_quality import brute, grams, limits
from tokenizers import Tokenizer

import corpus_pipeline as P
from tolmark.llm import bpe, quality
from tolmark.llm._tables import cut, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out, docs = [table(spark, SF, "documents")], table(spark, SF, "documents")
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return [x.collect() for x in out], out


def test_columns_and_order(steps):
    rows, frames = steps
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    assert [n for n, _ in P.STAGES] == ["quality", "line dedup", "near-dedup", "decontamination", "encoding"]
    assert 0 < len(rows[-1]) < len(rows[0])


def test_quality(spark, steps):
    before, after = steps[0][:2]
    good = {x.doc: x.held for x in quality.trusted(table(spark, SF, "labels")).withColumn("held", quality.F.pmod(quality.F.xxhash64("doc"), quality.F.lit(4)) == 0).collect()}
    p = brute([x.text for x in before if x.text and good.get(x.doc_id) is False])
    known = {}

    def cost(text):
        for g in set(grams(text)):
            if g not in known:
                known[g] = -np.log(p(g))
        return sum(known[g] for g in grams(text))

    found = [(x, cost(x.text), len(x.text)) for x in before if x.text]
    limit = limits([(x.lang, c, n) for x, c, n in found if good.get(x.doc_id)])
    want = {x.doc_id for x, c, n in found if x.lang not in limit or (c + quality.PRIOR * limit[x.lang][0]) / (n + quality.PRIOR) <= limit[x.lang][1] + 1e-6}
    assert {x.doc_id for x in after} == want | {x.doc_id for x in before if not x.text}
    assert len(after) < len(before)


def test_lines(steps):
    before, after = steps[0][1:3]
    assert sorted(((x.doc_id, x.text or "") for x in after), key=str) == lines_by_hand([(x.doc_id, x.text) for x in before], 40, 5)
    assert all(x.n_chars == len(x.text) for x in after)


def test_near(steps):
    before, after = steps[0][2:4]
    groups = groups_by_hand([(x.doc_id, x.text) for x in before], 5, 80, 100)
    assert {x.doc_id for x in after} == {d for d, _, c in groups if d == c}


def test_benchmark(spark, steps):
    before, after = steps[0][3:5]
    cut_words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def shingles(t, n=5):
        w = cut_words(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    items = [shingles(x.text) for x in table(spark, SF, "benchmark").collect()]
    want = {x.doc_id for x in before if not any(len(s & shingles(x.text)) >= 0.8 * len(s) for s in items if s)}
    assert {x.doc_id for x in after} == want


def test_tokens(steps):
    before, after = steps[0][4:6]
    library = Tokenizer.from_file(bpe.VOCABULARY)
    want = {x.doc_id: library.encode(x.text or "", add_special_tokens=False).ids for x in before}
    assert {x.doc_id: x.ids for x in after} == want
    assert all(x.n_tokens == len(x.ids) for x in after)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "plain words here", None, None, 16), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        step = frame
        for _, stage in P.STAGES:
            step = cut(stage(spark, step, SF), "odd")
        assert step.count() == frame.count()


def test_clashing_columns(spark):
    """Extra columns, called as the operators call theirs, come through every stage."""
    extra = ["doc", "rep", "lang2", "print", "bitmap", "lines", "own", "held", "fit", "block", "row", "component", "item", "word", "n"]
    rows = [(k, f"some plain words number {k} here", "en") for k in range(12)] + [(None, None, None), (3, "some plain words number 3 here", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(quality.F.lit(7).alias(c) for c in extra))
    for _, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), "clash")
        assert docs.columns == ["doc_id", "text", "lang", *extra]
        assert all(x[c] == 7 for x in docs.collect() for c in extra)
    kept = docs.count()
    assert kept and P.token_stage(spark, docs, SF).count() == kept
