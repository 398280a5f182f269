import math
import random

import numpy as np
import pytest

from tolmark.llm import top_k as K


def expected(rows, k, step):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in fine:
        if q % step == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in fine if c != q))[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, seed, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 90)
    monkeypatch.setattr(K, "BLOCK", 7)
    r = random.Random(seed)
    middle = [[r.gauss(0, 0.3) for _ in range(12)] for _ in range(4)]
    rows = [(k, [x + r.gauss(0, 0.05) for x in r.choice(middle)]) for k in range(300)]
    rows += [(300 + k, [0.5] * 12) for k in range(60)]  # one common vector
    rows += [(400, None), (401, [None] * 12), (402, [math.nan] * 12), (403, [math.inf] * 12), (None, [0.1] * 12), (404, [0.3] * 5), (405, []), (420, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS score")
    whole = K.integers(df, "vec_id", "embedding", 64)
    got = K.search(whole, whole.where("id % 20 = 0"), 10).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == expected(rows, 10, 20)
    assert K.search(whole.limit(0), whole.where("id % 20 = 0"), 10).count() == 0
    assert K.search(whole, whole.limit(0), 10).count() == 0


def test_large_values_stay_exact():
    r = np.random.default_rng(3)
    for top in (3, 10**4, 10**8):
        v = r.integers(-top, top + 1, (2000, 20))
        s = K.Shard(np.arange(2000), v)
        for own in range(5):
            ids, score = s.search(own, v[own], 20)
            want = sorted((-int(sum(int(a) * int(b) for a, b in zip(v[own], v[c]))), c) for c in range(2000) if c != own)[:20]
            assert [(-int(x), int(i)) for i, x in zip(ids, score)] == want


def test_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [2.0]), (1, [1.0]), (1, [1.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    whole = K.integers(df, "vec_id", "embedding", 64)
    got = sorted(map(tuple, K.search(whole, whole.where("id = 0"), 2).select("query_id", "vec_id", "score").collect()))
    assert len(got) == 2 and got[1] == (0, 2, 2 * 64 * 3 * 64)  # over both vectors of the query's id
