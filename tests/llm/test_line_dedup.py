import random

import numpy as np

from tolmark.llm import line_dedup as L


def expected(rows, min_chars, min_docs):
    def key(line):
        line = line.strip(" \t\n\v\f\r")
        return "".join(c.lower() if c.isascii() else c for c in line) if len(line) >= min_chars else None

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and (k := key(line)) is not None:
                holders.setdefault(k, set()).add(doc)
    out = []
    for doc, text in rows:
        stay = [x for x in (text or "").split("\n") if doc is None or key(x) is None or len(holders[key(x)]) < min_docs or doc == max(holders[key(x)])]
        out.append((doc, "\n".join(stay)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    lines = ["", "  ", "Short", "é" * 5, " THE same line ", "the SAME line\r", "ÉTÉ et encore", "x" * 40] + [f"line number {k}" for k in range(12)]
    rows = [(r.choice([None, *range(60)]), r.choice([None, "", "\n".join(r.choice(lines) for _ in range(r.randint(1, 14)))])) for _ in range(120)]
    rows += [(200 + k, "a hot line of all the documents\nown line %d" % k) for k in range(400)] + [(5, "repeat me"), (5, "repeat me")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS doc", "'y' AS bitmap", "2 AS print")
    for chars, docs in ((5, 5), (3, 2), (10, 30)):
        out = L.dedup_lines(df, "doc_id", "text", chars, docs)
        assert out.columns == df.columns
        assert sorted(((x.doc_id, x.text or "") for x in out.collect()), key=str) == expected(rows, chars, docs)
    assert L.dedup_lines(df.limit(0), "doc_id", "text").count() == 0


def test_bitmaps():
    r = random.Random(6)
    for _ in range(300):
        gone = sorted(r.sample(range(60), r.randint(1, 30)))
        keep = L.unpack(L.pack(gone))
        assert np.flatnonzero(~keep).tolist() == gone and len(keep) == gone[-1] + 1
