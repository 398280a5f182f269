import random
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest

from tolmark.llm import quality as Q


N = Q.ORDER


def symbols(text):
    return Q.BEGIN * (N - 1) + text


def grams(text):
    s = symbols(text)
    return [s[k : k + N] for k in range(len(text))]


def brute(texts):
    """Plain dictionaries: p(symbol | the ORDER - 1 symbols before), and the number of symbols of the vocabulary."""
    orders = {N: Counter(g for t in texts for g in grams(t))}
    for n in range(N - 1, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    discount, total, taken = {}, defaultdict(int), defaultdict(float)
    for n, c in orders.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else None
        discount[n] = [min(max(k - (k + 1) * y * m[k + 1] / m[k], 0.1), k) if m[k] and y is not None else k / 2 for k in (1, 2, 3)]
        for g, k in c.items():
            total[n, g[:-1]] += k
            taken[n, g[:-1]] += discount[n][min(k, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(orders[1]) + 1)
        n, lower = len(g), p(g[1:])
        if not total[n, g[:-1]]:
            return lower
        k = orders[n][g]
        return ((k - discount[n][min(k, 3) - 1] if k else 0) + taken[n, g[:-1]] * lower) / total[n, g[:-1]]

    return p


def limits(costs, quantile=Q.QUANTILE, prior=Q.PRIOR):
    """costs: (lang, sum of -log p, symbols) of left-out trusted documents. What a symbol usually costs and the threshold, by lang."""
    by = defaultdict(list)
    for lang, cost, n in costs:
        by[lang].append((cost, n))
    usual = {k: sum(c for c, _ in v) / sum(n for _, n in v) for k, v in by.items()}
    score = {k: [(c + prior * usual[k]) / (n + prior) for c, n in v] for k, v in by.items()}
    pooled = sum(np.var(v) * len(v) for v in score.values()) / sum(map(len, score.values()))
    z = NormalDist().inv_cdf(quantile)
    return {k: (usual[k], np.mean(v) + z * np.sqrt((len(v) * np.var(v) + Q.POOL * pooled) / (len(v) + Q.POOL) * (1 + 1 / len(v)))) for k, v in score.items()}


def frame(spark, texts):
    return spark.createDataFrame([(k, None, t, k % 3 > 0) for k, t in enumerate(texts)], "doc long, lang string, text string, fit boolean")


def asked_of(spark, texts, block=Q.BLOCK, shards=3):
    return Q.counts(Q.dealt(Q.listed(frame(spark, texts), block), shards))


def model_of(spark, texts, block=Q.BLOCK):
    return Q.model(asked_of(spark, texts, block).where("c > 0").select("gram", "c"))


def made(r, n):
    return "".join(r.choice("aabcd e.A1é!字") for _ in range(n))


def test_scores_against_brute_force(spark):
    r = random.Random(4)
    texts = [made(r, r.randint(1, 60)) for _ in range(60)] + [None, ""]
    orders = model_of(spark, texts, 400)
    p = brute([t for k, t in enumerate(texts) if t and k % 3])
    asked = {g for t in texts if t for g in grams(t)} | {g for _ in range(300) for g in grams(made(r, 8).replace("b", "x#"[r.random() < 0.5]))}
    got = {x.gram: x.p for x in Q.scores(spark.createDataFrame([(g,) for g in asked], "gram string"), orders).collect()}
    assert set(got) == asked
    for g in asked:
        assert got[g] == pytest.approx(p(g), rel=1e-9)
    # every context's probabilities sum to 1, what no text holds counting as one symbol; the contexts end at every order
    for context in ("aa b", "\0\0\0\0", "xxxx", "xxxa", "xx a", "xe a", "字é!1"):
        assert sum(p(context + c) for c in "abcd e.A1é!字x") == pytest.approx(1)


def test_no_probability_is_zero(spark):
    """Where every count is alike the formulas' discounts leave [0, k]; nothing may become impossible."""
    for texts in (["ab" * 40] * 3, ["abcdefgh"] * 9, ["a"] * 3, ["aabb" * 3, "ab", "ba"] * 3):
        orders = model_of(spark, texts)
        asked = {g for t in ("zzzzzz", "abzab", "aaaaaa", "bbbbbb", "ba") for g in grams(t)}
        got = Q.scores(spark.createDataFrame([(g,) for g in asked], "gram string"), orders).collect()
        assert len(got) == len(asked) and all(0 < x.p <= 1 for x in got)


def test_sums_over_blocks(spark, monkeypatch):
    """Blocks of any size, parts of long texts, empty texts and repeated rows give the same sums."""
    r = random.Random(6)
    texts = [made(r, n) for n in (1, 3, 5000, 40, 700, 700)] + [None, ""]
    p = brute([t for k, t in enumerate(texts) if t and k % 3])
    want = sorted((k, round(-sum(np.log(p(g)) for g in grams(t or "")), 2), len(t or "")) for k, t in enumerate(texts))
    for block, at_once, shard in ((None, Q.AT_ONCE, Q.SHARD), (50, 64, 40), (900, 1000, 300)):
        monkeypatch.setattr(Q, "SHARD", shard)
        monkeypatch.setattr(Q, "AT_ONCE", at_once)  # of the driver only; workers cut parts by the default
        got = sorted((x.doc, x.cost, x.n) for x in Q.costs(Q._settled(frame(spark, texts)), block).collect())
        assert [g[::2] for g in got] == [w[::2] for w in want]
        assert all(g[1] == pytest.approx(w[1], rel=1e-5, abs=0.02) for g, w in zip(got, want))


def test_parts_of_long_texts(monkeypatch):
    """A text cut into parts, each with its context, has the same n-grams."""
    r = random.Random(8)
    text = made(r, 3000)
    monkeypatch.setattr(Q, "AT_ONCE", 100)
    monkeypatch.setattr(Q, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = Q.pa.RecordBatch.from_pydict({"doc": [1, 2], "lang": ["a", None], "text": [text, ""]})
    held = list(Q._packed(iter([batch]), 350))
    assert len(held) > 5 and [n for n, _ in held] == list(range(len(held)))
    found = [g for _, parts in held for x in parts for g in (lambda w, c: ["".join(map(chr, w[k])) for k in c])(*Q.coded([x[3]]))]
    assert found == grams(text)


def test_rows(spark):
    r = random.Random(9)
    good = lambda: " ".join(r.choice(["the", "rain", "in", "spain", "falls", "mainly", "on", "plains"]) for _ in range(60)) + "."
    rows = [(k, good(), r.choice(["en", "de", None])) for k in range(400)]
    rows += [(1000 + k, "".join(r.choice("#$%&*ZQX!9") for _ in range(300)), "en") for k in range(20)]
    rows += [(2000, None, "en"), (2001, "", None), (None, good(), "en"), (2002, good(), "new"), (2002, good(), "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS doc", "2.0D AS perplexity", "'x' AS own", "0 AS fit", "'y' AS gram", "1 AS block", "2 AS held")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)] + [(0, 0, 0), (1, None, 0), (2, 1, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.judged(docs, "doc_id", "text", "lang", labels).collect()
    assert len(got) == len(rows)
    assert {x.doc for x in got if not x.kept} == set(range(1000, 1020))
    assert all(x.perplexity is None for x in got if x.doc in (2000, 2001))
    none = Q.judged(docs, "doc_id", "text", "lang", labels.limit(0)).collect()
    assert len(none) == len(rows) and all(x.kept for x in none)
    assert Q.judged(docs.limit(0), "doc_id", "text", "lang", labels).count() == 0


def test_rare_languages(spark):
    """A language with few trusted documents has its own threshold; one with none is kept."""
    r = random.Random(5)
    text = lambda words: " ".join(r.choice(words) for _ in range(60)) + "."
    large, rare, none = ["the", "rain", "in", "spain", "falls"], ["qyx", "wvuk", "zzob", "pjim", "xokk", "vuq"], ["ьжщ", "фыэ", "юяъ"]
    rows = [(k, text(large), "en") for k in range(300)]
    rows += [(1000 + k, text(rare), "rr") for k in range(60)]
    rows += [(2000 + k, text(none), "nn") for k in range(20)] + [(3000 + k, "".join(r.choice("#$%&*ZQX!9") for _ in range(300)), "rr") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(200), *range(1000, 1016)]], "doc_id long, quality int, toxic int")
    got = Q.judged(docs, "doc_id", "text", "lang", labels).collect()
    assert len(got) == len(rows)
    assert {x.doc for x in got if not x.kept} == set(range(3000, 3005))
    assert all(x.threshold is None for x in got if x.lang == "nn")
