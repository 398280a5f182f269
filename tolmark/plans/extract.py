"""The whole way from page tiles to a reviewed table, for any number of pages at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolmark.functions import geometry as G
from tolmark.functions import tolerance
from tolmark.operators import cluster, order, pairs, report, review, suppress
from tolmark.sources import provider


def detected(tiles: DataFrame, cv_boxes: DataFrame, factory: Callable[[], Any]) -> DataFrame:
    """page, ord, kind, box, conf: tile detections merged and freed of duplicates, rectangles taken in."""
    found = provider.detect_tiles(tiles, factory).withColumn("ord", F.col("tile") * 100_000 + F.col("ord")).withColumn("conf", F.col("conf") * 100)
    kept = suppress.same_kind(cluster.stack_merge(found))
    both = pairs.hybrid(kept, cv_boxes).withColumn("ord", F.when(F.col("source") == "cv", F.col("ord") + (1 << 40)).otherwise(F.col("ord")))
    return suppress.cross_kind(both)


def notes_region(found: DataFrame, cv_boxes: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """page and the region of its notes: the largest cluster, snapped to a rectangle if one fits, padded."""
    return pairs.snap(cluster.note_cluster(found).withColumn("ord", F.lit(0).cast("long")), cv_boxes, page_w, page_h).drop("ord")


def best_reads(boxes: DataFrame, factory: Callable[[], Any], crop: Callable, turned: Callable[[bytes, int], bytes]) -> DataFrame:
    """page, ord, kind, box, text, confidence, rotated: the better of an upright box's two reads, and whether the other comes close."""
    reads = provider.read_boxes(boxes, factory, crop, turned).withColumns(tolerance.parse(F.col("text"), F.lit("")))
    best = report.best_read(reads.withColumn("box", F.struct("page", "ord", "kind", *G.SIDES)), "box", F.lit(True))
    return best.select("box.*", "text", "confidence", F.col("ambiguous").alias("rotated"))


def characteristics(read: DataFrame, notes: DataFrame, dpi: int = 300) -> DataFrame:
    """read: page, ord, kind, box, text, confidence, and rotated if known. Parsed, retagged, flagged, numbered in reading order and placed."""
    rotated = F.col("rotated") if "rotated" in read.columns else F.lit(False)
    rows = read.withColumn("raw_text", F.col("text")).withColumns(tolerance.parse(F.col("text"), tolerance.hint_of(F.col("kind"))))
    rows = rows.withColumn("note_ref_pos", tolerance.note_reference(F.col("text"), F.col("kind")))
    rows = rows.withColumn("subtype", F.when(F.col("note_ref_pos").isNotNull(), "note_ref").when(F.col("kind").isin("gdt", "theoretical"), F.col("kind")).otherwise("")).withColumn("rotated", rotated)
    flagged = review.characteristics(rows, notes)
    placed = order.placement(read, dpi=dpi).select("page", "ord", "balloon_x", "balloon_y")
    return flagged.join(order.reading_order(read), ["page", "ord"]).join(placed, ["page", "ord"]).withColumn("source", F.lit("auto"))


def extract(tiles: DataFrame, images: DataFrame, cv_boxes: DataFrame, notes: DataFrame, factory: Callable[[], Any], crop: Callable = provider.whole, dpi: int = 300, turned: Callable[[bytes, int], bytes] | None = None) -> DataFrame:
    """tiles: page, tile, x0, y0, image. images: page, image. notes: page, pos, sub of the legends already read. turned: see provider.read_boxes."""
    found = detected(tiles, cv_boxes, factory).join(images, "page")
    read = best_reads(found, factory, crop, turned) if turned is not None else provider.read_boxes(found, factory, crop)
    return characteristics(read, notes, dpi)


def manual(regions: DataFrame, factory: Callable[[], Any], page_w: int, page_h: int, dpi: int = 300, crop: Callable = provider.whole) -> DataFrame:
    """regions: page, ord, x0, y0, x1, y1, image, drawn by hand: kept on the page, read, parsed and flagged; empty ones go. Not numbered."""
    kept = order.to_page(regions, F.lit(0), F.lit(0), page_w, page_h).where("x1 > x0 AND y1 > y0").withColumn("kind", F.lit(""))
    read = provider.read_boxes(kept, factory, crop)
    no_notes = read.select("page", F.lit(0).alias("pos"), F.lit(0).alias("sub")).limit(0)
    return characteristics(read, no_notes, dpi).withColumn("pos", F.lit(0)).withColumn("source", F.lit("manual"))


def gold_matches(found: DataFrame, gold: DataFrame, least: float = 0.3) -> DataFrame:
    """page, ord, gold, score: found rows assigned to gold rows one to one, the best score first; score is IoU plus 1 for the same nominal.

    Both: page, ord, box, nominal. A page's pairs are folded in order of score; a pair stays if neither side is taken.
    """
    near = pairs.overlap_join(found, gold).withColumn("iou", G.iou("a_", "b_")).where(F.col("iou") >= least)
    scored = near.withColumn("score", F.bround(F.col("iou") + F.when(F.col("a_nominal") == F.col("b_nominal"), 1.0).otherwise(0.0), 6))
    pair = F.struct((-F.col("score")).alias("s"), F.col("a_ord").alias("ord"), F.col("b_ord").alias("gold"))
    listed = scored.groupBy("page").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    free = lambda kept, p: F.forall(kept, lambda k: (k["ord"] != p["ord"]) & (k["gold"] != p["gold"]))
    kept = F.aggregate("pairs", F.filter("pairs", lambda _: F.lit(False)), lambda acc, p: F.when(free(acc, p), F.array_append(acc, p)).otherwise(acc))
    return listed.select("page", F.inline(kept)).select("page", "ord", "gold", (-F.col("s")).alias("score"))


def summary(chars: DataFrame) -> DataFrame:
    """The report of extract()'s rows."""
    rows = chars.withColumn("conf", (F.col("confidence") * 100).cast("int"))
    return report.summary(rows, pairs.duplicates(rows))
