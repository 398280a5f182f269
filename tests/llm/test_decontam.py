import random
import re

from tolmark.llm import decontam as D


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(t, n):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def expected(docs, items):
    out = {}
    for d, t in docs:
        for i, x in items:
            n = min(5, len(words(x)))
            if d is None or i is None or not n:
                continue
            own = shingles(x, n)
            common = len(own & shingles(t, n))
            if 100 * common >= 80 * len(own):
                out[d, i] = max(out.get((d, i), (0, 0)), (len(own), common))
    return {(*k, *v) for k, v in out.items()}


def test_against_brute_force(spark):
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "phi", "Été", "x1"]) + str(r.randrange(40)) for _ in range(n))
    items = [(k, some(r.choice([6, 12, 30, 70]))) for k in range(30)] + [(100, "two words"), (101, "one"), (102, ""), (103, None), (None, "no id at all here"), (104, "a b c d e"), (104, "a b c d e"), (0, None)]
    docs = [(k, some(60)) for k in range(60)]
    for k in range(120):
        w = r.choice(items[:30])[1].split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = "changed"
        docs.append((1000 + k, f"{some(r.choice([0, 5, 200]))}, {' '.join(w).upper()}! {some(3)}"))
    docs += [(None, items[0][1]), (3000, None), (3001, ""), (3002, "One"), (3003, "only TWO -- words, here"), (3004, "a b c d"), (3005, "a b c d e"), (3005, "a b c d e"), (3006, some(30_000) + " " + items[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "'w' AS w", "2 AS n", "3 AS item")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "'w' AS w", "9 AS need")
    got = D.contained(df, "doc_id", "text", it, "item_id", "text").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == expected(docs, items)
    assert D.contained(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert D.contained(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
