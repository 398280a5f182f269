"""Greedy suppression: boxes in an order, each kept if no kept box before it overlaps it too much.

The outcome depends on the order, so a group (a page, or a kind on a page) is folded from left to right in one expression:
an ordered aggregate over the sorted array of its boxes, which stays in the JVM. A page is one drawing: its boxes are few.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _inter(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def _area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def ratio_under(num: int, den: int) -> Callable[[Column, Column], Column]:
    """May stay beside: IoU under num / den."""
    return lambda a, b: (_inter(a, b) == 0) | (_inter(a, b) * den < (_area(a) + _area(b) - _inter(a, b)) * num)


def apart(a: Column, b: Column) -> Column:
    return _inter(a, b) == 0


def greedy(df: DataFrame, by: Sequence[str], order: Sequence[Column], beside: Callable[[Column, Column], Column], keep: Sequence[str] = ("ord",)) -> DataFrame:
    """by and keep columns of the boxes that stay. order: ascending keys; ord, the last key, makes it total."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    box = F.struct(*keys, *dict.fromkeys(["ord", *keep, "x0", "y0", "x1", "y1"]))
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    folded = F.aggregate("boxes", F.filter("boxes", lambda _: F.lit(False)), lambda kept, b: F.when(F.forall(kept, lambda k: beside(k, b)), F.array_append(kept, b)).otherwise(kept))
    return grouped.select(*by, F.explode(folded).alias("b")).select(*by, *(F.col(f"b.{c}").alias(c) for c in keep))


def same_kind(dets: DataFrame) -> DataFrame:
    """IoU >= 0.5 suppresses within a kind; kinds are groups of their own."""
    return greedy(dets, ["page", "kind"], [-F.col("conf")], ratio_under(1, 2), ("ord", "conf", "x0", "y0", "x1", "y1"))


def cross_kind(dets: DataFrame) -> DataFrame:
    return greedy(dets, ["page"], [-F.col("conf")], ratio_under(7, 10), ("ord", "kind", "conf", "x0", "y0", "x1", "y1"))


def by_area(boxes: DataFrame) -> DataFrame:
    return greedy(boxes, ["page"], [-(F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))], ratio_under(1, 2))


def first_come(dets: DataFrame) -> DataFrame:
    return greedy(dets, ["page"], [], apart)
