"""Review policies: reasons in a fixed order; a row needs review if it has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("Distance", "Diameter", "Radius", "Theoretical")
LOW = 0.6


def _blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"\S")


def reasons(*cases: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in cases)), lambda x: x.isNotNull())


def flagged(df: DataFrame, found: Column) -> DataFrame:
    return df.withColumn("review_reasons", found).withColumn("needs_review", F.size("review_reasons") > 0)


def characteristics(chars: DataFrame, notes: DataFrame) -> DataFrame:
    """chars: page, raw_text, confidence, char_type, nominal, rotated, subtype, note_ref_pos. notes: page, pos, sub.

    A note reference is unknown if it is null or no top-level position of its page's notes; a page without notes checks none.
    """
    top = notes.where("sub IS NULL").select("page", F.col("pos").alias("note_ref_pos")).distinct().withColumn("known", F.lit(True))
    paged = notes.select("page").distinct().withColumn("has_notes", F.lit(True))
    joined = chars.join(paged, "page", "left").join(top, ["page", "note_ref_pos"], "left")
    empty = _blank(F.col("raw_text"))
    found = reasons(
        (empty, "empty read"),
        (~empty & (F.col("confidence") < LOW), "low OCR confidence"),
        (~empty & F.col("char_type").isin(*DIMENSIONS) & (F.coalesce("nominal", F.lit("")) == ""), "missing nominal"),
        (F.col("rotated"), "rotation ambiguity"),
        ((F.col("subtype") == "note_ref") & F.col("has_notes") & F.col("known").isNull(), "unknown note reference"),
    )
    return flagged(joined, found).drop("known", "has_notes")


def notes(rows: DataFrame, two_columns: Column) -> DataFrame:
    """rows: page, pos, parent_pos, text_en, text_de, raw_text. A sub row whose parent is no top-level row of its page is an orphan."""
    parents = rows.where("parent_pos IS NULL").select("page", F.col("pos").alias("parent_pos")).distinct().withColumn("known", F.lit(True))
    joined = rows.join(parents, ["page", "parent_pos"], "left")
    empty = _blank(F.col("raw_text"))
    found = reasons(
        (empty, "empty read"),
        (~empty & two_columns & (_blank(F.col("text_en")) | _blank(F.col("text_de"))), "missing translation"),
        (F.col("parent_pos").isNotNull() & F.col("known").isNull(), "orphan sub-bullet"),
    )
    return flagged(joined, found).drop("known")


def marks(rows: DataFrame, two_columns: Column) -> DataFrame:
    empty = _blank(F.col("raw_text"))
    return flagged(rows, reasons((empty, "empty read"), (~empty & two_columns & (_blank(F.col("text_en")) | _blank(F.col("text_de"))), "missing translation")))


def title_fields(rows: DataFrame, expect_caption: bool = True) -> DataFrame:
    empty = _blank(F.col("value"))
    return flagged(rows, reasons((empty, "empty value"), (~empty & F.lit(expect_caption) & _blank(F.col("label")), "missing caption")))
