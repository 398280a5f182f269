"""Joins of boxes on overlap.

A pair of boxes that overlap shares a cell of a grid over the page; both sides are dealt out to the cells that they cover and joined
on (page, cell), so that a crowded page is many keys. Of the cells that a pair shares, the one with the corner of its
intersection counts, which gives each pair once without a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolmark.functions import geometry as G

CELL = 64


def _dealt(df: DataFrame, p: str, cell: int) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(p + lo) / cell), F.floor(F.greatest(F.col(p + lo), F.col(p + hi) - 1) / cell))
    return df.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def overlap_join(left: DataFrame, right: DataFrame, condition: Column | None = None, cell: int = CELL, page: str = "page") -> DataFrame:
    """Pairs whose interiors meet: columns of left prefixed a_, of right b_, and page."""
    a = _dealt(G.prefixed(left, "a_", (page,)), "a_", cell)
    b = _dealt(G.prefixed(right, "b_", (page,)), "b_", cell)
    corner = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    on = G.overlaps("a_", "b_") & corner
    return a.join(b, [page, "cx", "cy"]).where(on if condition is None else on & condition).drop("cx", "cy")


def duplicates(dets: DataFrame, num: int = 60, den: int = 100) -> DataFrame:
    """page, ord_a < ord_b, kind_a, kind_b, iou (half-even to 3 digits) of boxes that are probably one."""
    pairs = overlap_join(dets, dets, (F.col("a_ord") < F.col("b_ord")) & G.iou_at_least("a_", "b_", num, den))
    return pairs.select("page", F.col("a_ord").alias("ord_a"), F.col("b_ord").alias("ord_b"), F.col("a_kind").alias("kind_a"), F.col("b_kind").alias("kind_b"), F.bround(G.iou("a_", "b_"), 3).alias("iou"))


def having(left: DataFrame, right: DataFrame, condition: Column, how: str) -> DataFrame:
    """left_semi or left_anti: rows of left (by page and ord) with or without a partner."""
    found = overlap_join(left, right, condition).select("page", F.col("a_ord").alias("ord")).distinct()
    return left.join(found, ["page", "ord"], how)


def hybrid(dets: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rectangles that a detection supports (IoU over 0.5) replace the detections they overlap so; detections first."""
    supported = having(boxes, dets, G.iou_over("a_", "b_", 1, 2), "left_semi")
    rest = having(dets, supported, G.iou_over("a_", "b_", 1, 2), "left_anti")
    kind = F.when(F.col("cells") >= 2, "gdt").otherwise("theoretical")
    cv = supported.select("page", F.lit("cv").alias("source"), "ord", kind.alias("kind"), "x0", "y0", "x1", "y1", F.lit(100).alias("conf"))
    return rest.select("page", F.lit("model").alias("source"), "ord", "kind", "x0", "y0", "x1", "y1", "conf").unionByName(cv)


def without_overlap(loose: DataFrame, excluded: DataFrame) -> DataFrame:
    return having(loose, excluded, F.lit(True), "left_anti")


def owned(left: DataFrame, right: DataFrame, num: int = 1, den: int = 2) -> DataFrame:
    """Pairs in which the intersection covers at least num / den of the smaller box."""
    pairs = overlap_join(left, right, G.covers_smaller("a_", "b_", num, den))
    return pairs.select("page", F.col("a_ord").alias("ord"), F.col("b_ord").alias("owner"))


def snap(proposals: DataFrame, boxes: DataFrame, width: int, height: int, pad: int = 8) -> DataFrame:
    """Each proposal as the largest box with IoU >= 0.4 that is no smaller, else itself; padded and kept on the page."""
    fits = overlap_join(proposals, boxes, G.iou_at_least("a_", "b_", 2, 5) & (G.area("b_") >= G.area("a_")))
    best = fits.groupBy("page", F.col("a_ord").alias("ord")).agg(F.max_by(F.struct(*(F.col(f"b_{s}").alias(s) for s in G.SIDES)), F.struct(G.area("b_").alias("area"), (-F.col("b_ord")).alias("ord"))).alias("to"))
    own = proposals.join(best, ["page", "ord"], "left")
    side = {s: F.coalesce(F.col(f"to.{s}"), F.col(s)) for s in G.SIDES}
    return own.select("page", "ord", F.greatest(F.lit(0), side["x0"] - pad).alias("x0"), F.greatest(F.lit(0), side["y0"] - pad).alias("y0"), F.least(F.lit(width), side["x1"] + pad).alias("x1"), F.least(F.lit(height), side["y1"] + pad).alias("y1"))
