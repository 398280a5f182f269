"""Regions of a page: rectangles by size, searched quadrants, grid cells, title block, legend, note tables, loose text, and reports on them.

Every step is a filter, an overlap join or an aggregate by page. Rows with a null side are in no region, and pages without a
region have no row, but in location(), which has one for each page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolmark.functions import geometry as G
from tolmark.operators import ink, pairs, review, suppress, transcripts

Box = tuple[int, int, int, int]


def rectangles(found: DataFrame, page_w: int, page_h: int, least: int = 12, percent: int = 5) -> DataFrame:
    """Those whose sides are no shorter than `least` and that cover no more than so much of the page."""
    return found.where((G.width() >= least) & (G.height() >= least) & (G.area() * 100 <= percent * page_w * page_h))


def inset(found: DataFrame, by: int = 4) -> DataFrame:
    """found with in_x0 ...: the box without its frame, or the whole box if nothing would be left."""
    left = (G.width() > 2 * by) & (G.height() > 2 * by)
    return found.withColumns({f"in_{s}": F.when(left, F.col(s) + (by if s[1] == "0" else -by)).otherwise(F.col(s)) for s in G.SIDES})


def lower_right(page_w: int, page_h: int) -> Box:
    """Where title blocks are looked for."""
    return int(page_w * 0.5), int(page_h * 0.6), page_w, page_h


def upper_right(page_w: int, page_h: int) -> Box:
    """Where legends are looked for."""
    return int(page_w * 0.5), 0, page_w, int(page_h * 0.55)


def grid_cells(cells: DataFrame, region: Box, has_ink: Column, least_w: int = 40, least_h: int = 18) -> DataFrame:
    """Cells inside a region that hold ink, are no slivers, and are not the region itself. A region of under 40 pixels has none."""
    x0, y0, x1, y1 = region
    inside = (F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1)
    all_of_it = (G.width() * 100 > 95 * (x1 - x0)) & (G.height() * 100 > 95 * (y1 - y0))
    fits = (G.width() >= least_w) & (G.height() >= least_h) & ~all_of_it
    return cells.where(inside & fits & has_ink & F.lit(min(x1 - x0, y1 - y0) >= 40))


def title_region(cells: DataFrame) -> DataFrame:
    """page, the box around its cells, and their number."""
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return cells.groupBy("page").agg(*sides, F.count("*").alias("cells"))


def legend_region(cells: DataFrame) -> DataFrame:
    """The same of the row band that holds the most stacked cells."""
    return ink.legend_band(cells)


def note_sources(legends: DataFrame, tables: DataFrame) -> DataFrame:
    """page, source (0 the legend, 1 another table), box. A table that shares half of the smaller one's area with the legend is the legend."""
    same = pairs.owned(tables.withColumn("ord", F.lit(0)), legends.withColumn("ord", F.lit(0))).select("page").distinct()
    rest = tables.join(same, "page", "left_anti")
    return legends.select("page", F.lit(0).alias("source"), *G.SIDES).unionByName(rest.select("page", F.lit(1).alias("source"), *G.SIDES))


def notes_of(sources: DataFrame, reads: DataFrame) -> DataFrame:
    """Notes of all of a page's tables, reviewed together: a sub row's parent may be in any of them.

    sources: page, source, two_columns. reads: page, source, raw (null or missing: nothing was read).
    """
    block = (F.col("page") * 2 + F.col("source")).alias("block")
    blocks = sources.select("page", "source").join(reads, ["page", "source"]).select(block, "raw")
    rows = transcripts.notes(transcripts.legend(blocks))
    placed = rows.withColumn("source", F.pmod("page", F.lit(2)).cast("int")).withColumn("page", F.shiftright("page", 1)).withColumnRenamed("raw", "raw_text")
    return review.notes(placed.join(sources.select("page", "source", "two_columns"), ["page", "source"]), F.col("two_columns"))


def title_fields(cells: DataFrame, reads: DataFrame) -> DataFrame:
    """page, ord, label, label_en, label_de, value, review_reasons, needs_review. cells: page, ord. reads: page, ord, raw; cells without any text go."""
    key = F.struct("page", "ord").alias("cell")
    read = transcripts.title_cells(cells.select("page", "ord").join(reads, ["page", "ord"]).select(key, "raw"))
    return review.title_fields(read).select("cell.page", "cell.ord", "label", "label_en", "label_de", "value", "review_reasons", "needs_review")


def loose_regions(notes: DataFrame, *taken: DataFrame) -> DataFrame:
    """page, ord of notes that meet none of the taken boxes, nor one another: of those that meet, the first stays."""
    boxes = reduce(DataFrame.unionByName, (t.select("page", *G.SIDES) for t in taken))
    return suppress.first_come(pairs.without_overlap(notes, boxes))


def with_loose(fields: DataFrame, loose: DataFrame) -> DataFrame:
    """Title fields and, after them, loose text (page, ord, text), which has no caption and needs no review. Blank text goes."""
    text = transcripts.strip(F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    own = loose.select("page", "ord", *(F.lit("").alias(c) for c in ("label", "label_en", "label_de")), text.alias("value"), none.alias("review_reasons"), F.lit(False).alias("needs_review"))
    return fields.withColumn("source", F.lit("cell")).unionByName(own.where("value <> ''").withColumn("source", F.lit("loose")))


def location(pages: DataFrame, legends: DataFrame, titles: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """A row for each page: whether legend and title block were found, and how much of the page each spans (half-even to 3 digits)."""

    def spans(region: DataFrame, name: str) -> DataFrame:
        share = {"w": G.width() / page_w, "h": G.height() / page_h}
        return region.select("page", F.lit(True).alias(f"{name}_located"), F.col("cells").alias(f"{name}_cells"), *(F.bround(c, 3).alias(f"{name}_{k}_frac") for k, c in share.items()))

    both = pages.select("page").distinct().join(spans(legends, "legend"), "page", "left").join(spans(titles, "title"), "page", "left")
    return both.fillna(False, ["legend_located", "title_located"])


def optional_counts(chars: DataFrame, notes: DataFrame, marks: DataFrame, title: DataFrame) -> DataFrame:
    """A row for each page of chars: how many rows of each relation; null where a page has no notes or marks, 0 where it has no title fields."""
    each = [rows.groupBy("page").agg(F.count("*").alias(name)) for name, rows in (("notes", notes), ("marks", marks), ("title_fields", title))]
    counted = chars.groupBy("page").agg(F.count("*").alias("characteristics"))
    return reduce(lambda a, b: a.join(b, "page", "left"), each, counted).fillna(0, ["title_fields"])


# The steps of an extraction, in order.
STEPS = ("render", "notes", "title", "detect")


def progress(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page, seq (from 1), step, current, total: the steps, then a reading step for none and for each of the page's boxes, then placing."""
    held = pages.select("page").distinct().join(found.groupBy("page").agg(F.count("*").alias("n")), "page", "left").fillna(0, ["n"])
    first = len(STEPS) + 1
    steps = held.withColumn("seq", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + first + 1)))
    reading = (F.col("seq") >= first) & (F.col("seq") <= F.col("n") + first)
    named = F.when(F.col("seq") < first, F.get(F.array(*map(F.lit, STEPS)), (F.col("seq") - 1).cast("int"))).when(reading, "ocr").otherwise("place")
    return steps.select("page", "seq", named.alias("step"), F.when(reading, F.col("seq") - first).alias("current"), F.when(reading, F.col("n")).alias("total"))
