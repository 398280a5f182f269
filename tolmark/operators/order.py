"""Ranks, tiles and placements of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tolmark.functions import geometry as G


def reading_order(dets: DataFrame, band: int = 60) -> DataFrame:
    """page, ord, pos: rows of boxes top to bottom, left to right within a row; bands round half to even."""
    cx, cy = G.center()
    w = W.partitionBy("page").orderBy(F.bround(cy / band), cx, "ord")
    return dets.select("page", "ord", F.row_number().over(w).alias("pos"))


def reading_order_client(dets: DataFrame, band: int = 60) -> DataFrame:
    """The same with bands that round half up, and the balloon's place where a row has no region (x0 is null)."""
    cx, cy = G.center()
    place = lambda own, other: F.coalesce(own, F.col(other) if other in dets.columns else F.lit(0.0), F.lit(0.0))
    w = W.partitionBy("page").orderBy(F.floor(place(cy, "balloon_y") / band + 0.5), place(cx, "balloon_x"), "ord")
    return dets.select("page", "ord", F.row_number().over(w).alias("pos"))


def cell_order(cells: DataFrame, band: int = 30) -> DataFrame:
    w = W.partitionBy("page").orderBy(F.bround(F.col("y0") / band), "x0", "ord")
    return cells.select("page", "ord", F.row_number().over(w).alias("rank"))


def placement(dets: DataFrame, dpi: int = 300, gap_pt: float = 14.0, margin: int = 10, offset: int | None = None, page_w: float = 595.0, page_h: float = 842.0) -> DataFrame:
    """page, ord, the balloon up and left of the box's corner, and the box's centre in points on the PDF page."""
    gap = offset if offset is not None else round(gap_pt * dpi / 72.0)  # half to even
    scale = dpi / 72.0
    cx, cy = G.center()
    pt = lambda v, most: F.least(F.greatest(v / scale, F.lit(0.0)), F.lit(most))
    return dets.select(
        "page", "ord", F.greatest(F.lit(margin), F.col("x0") - gap).alias("balloon_x"), F.greatest(F.lit(margin), F.col("y0") - gap).alias("balloon_y"),
        F.bround(pt(cx, page_w), 4).alias("pt_x"), F.bround(pt(cy, page_h), 4).alias("pt_y"),
    )


def tiles(pages: DataFrame, key: str, width: Column, height: Column, tile: int = 1024, overlap: float = 0.15) -> DataFrame:
    """key, x0, y0, x1, y1: overlapping tiles that cover each page; the last of a row or column is flush with its end."""
    step = max(1, int(tile * (1 - overlap)))
    sized = pages.select(F.col(key), width.cast("int").alias("w"), height.cast("int").alias("h"))
    starts = sized.withColumn("y0", F.explode(G.tile_starts(F.col("h"), tile, step))).withColumn("x0", F.explode(G.tile_starts(F.col("w"), tile, step)))
    return starts.select(key, "x0", "y0", F.least(F.col("x0") + tile, F.col("w")).alias("x1"), F.least(F.col("y0") + tile, F.col("h")).alias("y1"))


def to_page(found: DataFrame, origin_x: Column, origin_y: Column, width: int, height: int) -> DataFrame:
    """Boxes in tile coordinates, moved by the tile's origin and kept on the page."""
    moved = {"x0": origin_x, "x1": origin_x, "y0": origin_y, "y1": origin_y}
    return found.withColumns({s: G.clamped(F.col(s) + o, 0, width if s[0] == "x" else height) for s, o in moved.items()})


def vertical(dets: DataFrame) -> Column:
    """Taller than 1.3 times its width."""
    return G.height() * 10 > G.width() * 13


def crop_size(w: Column, h: Column, pad: int, page_w: int, page_h: int, least: int = 40, most: int = 3) -> tuple[Column, Column]:
    """Size of a padded crop, enlarged by up to `most` if it is lower than `least` pixels."""
    cw, ch = F.least(w + 2 * pad, F.lit(page_w)), F.least(h + 2 * pad, F.lit(page_h))
    up = F.when((ch > 0) & (ch < least), F.least(F.lit(float(most)), least / ch)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(1), (cw * up).cast("int")), F.greatest(F.lit(1), (ch * up).cast("int"))


def capped(w: Column, h: Column, most: int = 1600) -> tuple[Column, Column]:
    """Size with a long edge of at most `most`, in proportion."""
    long = F.greatest(w, h)
    scaled = lambda v: F.when(long <= most, v).otherwise(F.greatest(F.lit(1), (v * (most / long)).cast("int")))
    return scaled(w), scaled(h)
