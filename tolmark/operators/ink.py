"""Ink of a small patch, held as a flat array of its pixels row by row: dark is true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sums(ink: Column, outer: int, at) -> Column:
    """Ink pixels of each of `outer` rows or columns; at(k) gives the array of its pixels."""
    return F.transform(F.sequence(F.lit(0), F.lit(outer - 1)), lambda k: F.size(F.filter(at(ink, k), lambda x: x)))


def row_sums(ink: Column, w: int, h: int) -> Column:
    return _sums(ink, h, lambda a, k: F.slice(a, k * w + 1, w))


def column_sums(ink: Column, w: int, h: int) -> Column:
    return _sums(ink, w, lambda a, k: F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.element_at(a, (r * w + k + 1).cast("int"))))


def has_ink(ink: Column, share: float = 0.004) -> Column:
    return F.size(F.filter(ink, lambda x: x)) >= share * F.size(ink)


def extent(df: DataFrame, ink: Column, w: int, h: int, pad: int = 3, least_percent: int = 2) -> DataFrame:
    """df with x0, y0, x1, y1: the bounds of rows and columns with ink, padded; the whole patch if there is none or too little."""
    floor_row, floor_col = max(1, w // 100), max(1, h // 100)
    where = lambda sums, least: F.filter(F.transform(sums, lambda s, k: F.when(s >= least, k)), lambda k: k.isNotNull())
    found = df.withColumn("_r", where(row_sums(ink, w, h), floor_row)).withColumn("_c", where(column_sums(ink, w, h), floor_col))
    side = {
        "x0": F.greatest(F.lit(0), F.array_min("_c") - pad), "y0": F.greatest(F.lit(0), F.array_min("_r") - pad),
        "x1": F.least(F.lit(w), F.array_max("_c") + 1 + pad), "y1": F.least(F.lit(h), F.array_max("_r") + 1 + pad),
    }
    enough = F.coalesce((side["x1"] - side["x0"]) * (side["y1"] - side["y0"]) * 100 >= least_percent * w * h, F.lit(False))
    whole = {"x0": 0, "y0": 0, "x1": w, "y1": h}
    return found.withColumns({s: F.when(enough, c).otherwise(F.lit(whole[s])) for s, c in side.items()}).drop("_r", "_c")


def cells(ink: Column, w: int, h: int) -> Column:
    """One more than the runs of columns with ink over 60 % of their height."""
    full = F.transform(column_sums(ink, w, h), lambda s: s * 10 > 6 * h)
    rising = F.filter(F.transform(full, lambda f, k: f & ~F.when(k > 0, F.element_at(full, F.greatest(k, F.lit(1)))).otherwise(F.lit(False))), lambda x: x)
    return F.size(rising) + 1


def split_column(ink: Column, w: int, h: int) -> Column:
    """The strongest column over 60 % ink between 30 and 70 % of the width (the first of equals); null if there is none."""
    lo, hi = w * 3 // 10, w * 7 // 10
    strong = F.filter(F.transform(column_sums(ink, w, h), lambda s, k: F.struct(s.alias("s"), (-k).alias("k"))), lambda x: (x["s"] * 10 > 6 * h) & (-x["k"] >= lo) & (-x["k"] < hi))
    return -F.array_max(strong)["k"]


def legend_band(cells: DataFrame) -> DataFrame:
    """page and the union of the cells in the row band of the page's fullest column of cells; of all cells if no column has two."""
    from pyspark.sql import Window as W

    columns = cells.withColumn("column", F.bround(F.col("x0") / 15).cast("int"))
    of = W.partitionBy("page")
    grouped = columns.groupBy("page", "column").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min("y0").alias("by0"), F.max("y1").alias("by1"))
    anchor = grouped.withColumn("rank", F.row_number().over(of.orderBy(F.desc("n"), "first"))).where("rank = 1").select("page", "n", "by0", "by1")
    tol = F.greatest(F.lit(20), ((F.col("by1") - F.col("by0")) * 0.05).cast("int"))
    inside = (F.col("n") < 2) | ((F.col("y0") >= F.col("by0") - tol) & (F.col("y1") <= F.col("by1") + tol))
    band = cells.join(anchor, "page").where(inside)
    return band.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("cells"))
