import random
import re

import pytest

from tolmark.llm import near_dup as N
from tolmark.llm._components import components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    least = {d: d for d, _ in rows if d is not None}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets)), key=str)


def texts(r):
    base = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("xyz") for _ in range(r.choice([40, 80, 200]))) for _ in range(6)]
    out = []
    for _ in range(150):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 3, 6, 10])):
            w[r.randrange(len(w))] = r.choice(["new", "word", "zz"])
        out.append(r.choice([" ", "\n", "  \t"]).join(w))
    return out


@pytest.mark.parametrize(("n", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, n, num, den):
    r = random.Random(11)
    rows = list(enumerate(texts(r)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one"), (None, None), (1006, "one two"), (1007, "w " * 30_000), (1008, "W\n" * 30_000), (1009, " ".join(f"w{k}" for k in range(20_000)))]
    rows += [(2000 + k, "a group of exact copies that is large, with more words") for k in range(300)] + [rows[0], rows[0]]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS doc", "'k' AS bands", "8 AS rep")
    got = N.near_groups(df, "doc_id", "text", n, num, den).collect()
    assert sorted(((x.doc, x.n_shingles, x.component) for x in got), key=str) == expected(rows, n, num, den)
    assert N.near_groups(df.limit(0), "doc_id", "text", n, num, den).count() == 0


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 400), (400, 450), (None, 3), (7, 7), (500, 400)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {500: 400, 450: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_estimates_and_bands():
    import numpy as np

    r = np.random.default_rng(1)
    h = N.MinHash(*N.banding(0.85))
    lost = passed = 0
    for _ in range(300):
        shared, own = r.integers(0, 1 << 63, 850, dtype=np.uint64), [r.integers(0, 1 << 63, 75, dtype=np.uint64) for _ in range(2)]
        s = np.array([h.samples(np.concatenate([shared, x])) for x in own])
        bits = sum(int(x).bit_count() for x in (h.sketch(s)[0] ^ h.sketch(s)[1]).view(np.uint64))
        lost += bits > N.sketch_limit(h.bands * h.rows, 0.85) or not (h.keys(s)[0] == h.keys(s)[1]).any()
        far = np.array([h.samples(r.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(2)])
        passed += sum(int(x).bit_count() for x in (h.sketch(far)[0] ^ h.sketch(far)[1]).view(np.uint64)) <= N.sketch_limit(h.bands * h.rows, 0.85)
    assert lost == 0 and passed == 0


def test_long_words_of_two_letters(spark):
    """Words over which polynomial hashes modulo 2^64 agree for every base: complementary Thue-Morse words."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 85, 100).collect()
    assert sorted((x.doc, x.component) for x in got) == [(1, 1), (2, 2), (3, 1)]


def test_word_hashes_tell_words_apart():
    import itertools

    import pyarrow as pa

    words = ["".join(w) for n in range(1, 8) for w in itertools.product("abé", repeat=n)] + ["a" * n for n in range(8, 300)]
    found = [s.tolist() for s in N._shingles.sets(pa.array(words), 3)]
    assert all(len(s) == 1 for s in found) and len({s[0] for s in found}) == len(words)


def test_hot_groups(spark, monkeypatch):
    """The joins of large tables, in which hot groups are broadcast and the others dealt by key."""
    from tolmark.llm import _components, _tables

    monkeypatch.setattr(_tables, "HOT", 6)
    for module in (_tables, N):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 20)
    r = random.Random(12)
    rows = list(enumerate(texts(r))) + [(2000 + k, "a group of exact copies, with more words") for k in range(60)] + [(2001, None), (None, "one")]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 85, 100).collect()
    assert sorted(((x.doc, x.n_shingles, x.component) for x in got), key=str) == expected(rows, 3, 85, 100)
    links = [(0, k) for k in range(1, 40)] + [(k, k + 100) for k in range(30)] + [(200, 201)]
    found = {x.node: x.component for x in _components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in [*range(1, 40), *range(100, 130)]} | {201: 200}


def test_repeated_id_with_other_text(spark):
    """Both texts of an id link it."""
    words = [f"w{k}" for k in range(100)]
    one, two = " ".join(words), " ".join(w + "x" for w in words)
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, "alone here"), (5, "same again"), (6, "same again"), (6, "and this"), (7, "and this"), (8, "and this"), (8, None)]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 85, 100).collect()
    assert sorted((x.doc, x.component) for x in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (6, 5), (7, 5), (8, 5), (8, 5)]
