"""Box arithmetic as Column expressions. A box is four columns named with a prefix: ``{p}x0 {p}y0 {p}x1 {p}y1``.

Comparisons of an overlap ratio with a threshold are cross-multiplied, so that integer boxes compare exactly and nothing is
divided by zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def col(p: str, side: str) -> Column:
    return F.col(f"{p}{side}")


def width(p: str = "") -> Column:
    return col(p, "x1") - col(p, "x0")


def height(p: str = "") -> Column:
    return col(p, "y1") - col(p, "y0")


def area(p: str = "") -> Column:
    return width(p) * height(p)


def intersection(a: str, b: str) -> Column:
    w = F.least(col(a, "x1"), col(b, "x1")) - F.greatest(col(a, "x0"), col(b, "x0"))
    h = F.least(col(a, "y1"), col(b, "y1")) - F.greatest(col(a, "y0"), col(b, "y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def union_area(a: str, b: str) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou_at_least(a: str, b: str, num: int, den: int) -> Column:
    """Intersection over union >= num / den; no intersection counts as 0."""
    i = intersection(a, b)
    return (i > 0) & (i * den >= union_area(a, b) * num)


def iou_over(a: str, b: str, num: int, den: int) -> Column:
    return intersection(a, b) * den > union_area(a, b) * num


def iou(a: str, b: str) -> Column:
    i = intersection(a, b)
    return F.when(i > 0, i / union_area(a, b)).otherwise(F.lit(0.0))


def overlaps(a: str, b: str) -> Column:
    """Interiors meet; touching edges don't."""
    return (col(a, "x0") < col(b, "x1")) & (col(b, "x0") < col(a, "x1")) & (col(a, "y0") < col(b, "y1")) & (col(b, "y0") < col(a, "y1"))


def covers_smaller(a: str, b: str, num: int, den: int) -> Column:
    """Intersection over the smaller area >= num / den; false for empty areas."""
    i, small = intersection(a, b), F.least(area(a), area(b))
    return (i > 0) & (small > 0) & (i * den >= small * num)


def x_aligned(a: str, b: str, tol: int) -> Column:
    return (col(a, "x0") <= col(b, "x1") + tol) & (col(b, "x0") <= col(a, "x1") + tol)


def y_close(a: str, b: str, gap: int) -> Column:
    return F.greatest(col(a, "y0"), col(b, "y0")) - F.least(col(a, "y1"), col(b, "y1")) <= gap


def clamped(x: Column, low: Column | int, high: Column | int) -> Column:
    """Truncated to int and kept within [low, high]."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x.cast("int")))


def center(p: str = "") -> tuple[Column, Column]:
    return (col(p, "x0") + col(p, "x1")) / 2, (col(p, "y0") + col(p, "y1")) / 2


def prefixed(df, p: str, keep: tuple[str, ...] = ()):
    return df.select(*keep, *(F.col(c).alias(p + c) for c in df.columns if c not in keep))


def tile_starts(length: Column, tile: int, step: int) -> Column:
    """Where tiles begin along an axis; the last one is flush with the far end, one tile covers what is no longer."""
    regular = F.sequence(F.lit(0), F.greatest(length - tile, F.lit(0)), F.lit(step))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(length - tile)))
