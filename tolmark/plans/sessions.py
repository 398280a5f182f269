"""Queries over progress, edits and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolmark.operators import ink
from tolmark.plans.registry import Source, query
from tolmark.streaming import edits

SIDE = 8


def _dark(s: Source) -> DataFrame:
    return s.ink.where("v IS NOT NULL").withColumn("ink", F.transform("v", lambda x: F.coalesce(x < 0, F.lit(False))))


SUMS = """,
k AS (SELECT patch, list_transform(v, lambda x: CASE WHEN x < 0 THEN 1 ELSE 0 END) AS b FROM ink WHERE v IS NOT NULL),
rs AS (SELECT patch, list_transform(range(0, 8), lambda r: list_sum(b[r * 8 + 1 : r * 8 + 8])::INT) AS rows, list_transform(range(0, 8), lambda c: (b[c + 1] + b[c + 9] + b[c + 17] + b[c + 25] + b[c + 33] + b[c + 41] + b[c + 49] + b[c + 57])::INT) AS cols FROM k)
"""


@query(SUMS + """
SELECT patch, greatest(0, list_min(c) - 1)::INT AS x0, greatest(0, list_min(r) - 1)::INT AS y0, least(8, list_max(c) + 2)::INT AS x1, least(8, list_max(r) + 2)::INT AS y1
FROM (SELECT patch, list_filter(range(0, 8), lambda i: rows[i + 1] >= 1) AS r, list_filter(range(0, 8), lambda i: cols[i + 1] >= 1) AS c FROM rs)""")
def ink_extent(s: Source) -> DataFrame:
    return ink.extent(_dark(s), F.col("ink"), SIDE, SIDE, pad=1).select("patch", "x0", "y0", "x1", "y1")


@query(SUMS + """
SELECT patch, (1 + len(list_filter(range(1, 9), lambda i: cols[i] * 10 > 48 AND (i = 1 OR cols[greatest(i - 1, 1)] * 10 <= 48))))::INT AS cells FROM rs""")
def ink_divider_count(s: Source) -> DataFrame:
    return _dark(s).select("patch", ink.cells(F.col("ink"), SIDE, SIDE).alias("cells"))


@query(SUMS + """
SELECT patch, list_filter([2, 3, 4], lambda i: cols[i + 1] * 10 > 48 AND cols[i + 1] = list_max(list_filter(cols[3:5], lambda x: x * 10 > 48)))[1]::INT AS split FROM rs""")
def ink_column_split(s: Source) -> DataFrame:
    return _dark(s).select("patch", ink.split_column(F.col("ink"), SIDE, SIDE).alias("split"))


@query(SUMS + "SELECT patch, list_sum(rows) >= 0.45 * 64 AS inked, list_sum(rows)::INT AS pixels FROM rs")
def ink_share(s: Source) -> DataFrame:
    return _dark(s).select("patch", ink.has_ink(F.col("ink"), 0.45).alias("inked"), F.size(F.filter("ink", lambda x: x)).alias("pixels"))


@query("SELECT user_id, arg_max(event_type, event_id) AS latest, count(*) AS events FROM events GROUP BY user_id")
def latest_progress(s: Source) -> DataFrame:
    return edits.latest(s.table("events"), "user_id", "event_id", "event_type")


@query()
def oplog_replay(s: Source) -> DataFrame:
    """Edit logs folded for each session; held against a plain loop in the tests."""
    return edits.replay(s.edits)
