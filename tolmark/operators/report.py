"""Summaries, samples and sheets of reviewed characteristics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tolmark.functions import geometry as G


def histogram(df: DataFrame, value: str) -> DataFrame:
    """value, n; blanks don't count."""
    return df.where((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy(value).agg(F.count("*").alias("n"))


def box_sizes(dets: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """A row for each page with boxes: exact medians and maxima of width and height as shares of the page, and how many are oversized."""
    w, h = G.width() / page_w, G.height() / page_h
    own = dets.where("x0 IS NOT NULL").select("page", w.alias("w"), h.alias("h"))
    figures = [F.bround(f(c), 4).alias(f"{n}_{c}_frac") for n, f in (("median", F.median), ("max", F.max)) for c in ("w", "h")]
    return own.groupBy("page").agg(*figures, F.count_if((F.col("w") > 0.15) | (F.col("h") > 0.10)).alias("oversized"))


def best_read(reads: DataFrame, key: str, vertical: Column, margin: float = 0.15) -> DataFrame:
    """reads: key, candidate, text, nominal, upper_tol, confidence. The best-scored candidate (the first of equals), and whether the runner-up is close."""
    score = F.when(F.col("nominal") != "", 1.0).otherwise(0.0) + F.when(F.col("upper_tol") != "", 0.5).otherwise(0.0) + F.col("confidence")
    w = W.partitionBy(key).orderBy(F.desc("score"), "candidate")
    ranked = reads.withColumn("score", score).withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    close = vertical & F.col("next").isNotNull() & F.col("text").rlike(r"\S") & (F.col("score") - F.col("next") < margin)
    return ranked.where("rank = 1").select(key, "candidate", "text", "confidence", F.coalesce(close, F.lit(False)).alias("ambiguous"))


def words_joined(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """words: key, ord, word, conf (text). Non-blank words in order, and the mean of numeric confidences as a share (0 without any)."""
    said = F.filter(F.array_sort(F.collect_list(F.struct("ord", F.trim("word").alias("t"), F.col("conf").try_cast("double").alias("c")))), lambda x: x["t"] != "")
    folded = words.groupBy(*key).agg(said.alias("s"))
    numbers = F.filter(F.transform("s", lambda x: x["c"]), lambda c: c.isNotNull())
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(numbers), F.lit(0)) / 100
    return folded.select(*key, F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"), F.coalesce(mean, F.lit(0.0)).alias("confidence"))


def mean_confidence(steps: Column) -> Column:
    """Of an array of probabilities; 0 for an empty one."""
    return F.coalesce(F.try_divide(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x), F.size(steps)), F.lit(0.0))


def is_open() -> Column:
    return F.col("needs_review") & ~F.col("reviewed")


def review_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """all, review, ok, done (reviewed, or nothing to review)."""
    return rows.groupBy(*by).agg(F.count("*").alias("all"), F.count_if(is_open()).alias("review"), F.count_if(~is_open()).alias("ok"), F.count_if(F.col("reviewed") | ~F.col("needs_review")).alias("done"))


def visible(rows: DataFrame, state: str = "all", search: str = "") -> DataFrame:
    """The rows that a filter (all, review, ok) and a search term show."""
    shown = F.lit(True) if state == "all" else is_open() if state == "review" else ~is_open()
    term = search.strip().lower()
    hay = F.lower(F.concat_ws(" ", F.col("pos").cast("string"), "char_type", "nominal", "upper_tol", "lower_tol"))
    return rows.where(shown & hay.contains(term) if term else shown)


def bulk_accept(rows: DataFrame, checked: DataFrame | None, state: str = "all", search: str = "") -> DataFrame:
    """rows with reviewed set for the checked ids, or, without any, for all visible rows."""
    target = checked if checked is not None else visible(rows, state, search).select("id")
    return rows.join(target.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn("reviewed", F.col("reviewed") | F.coalesce("hit", F.lit(False))).drop("hit")


def sample(rows: DataFrame, by: str, order: Sequence[str], most: int) -> DataFrame:
    """The first rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def read_sample(raw: Column) -> Column:
    return F.substring(F.translate(F.coalesce(raw, F.lit("")), "\n", " "), 1, 40)


def raw_summary(raw: Column) -> dict[str, Column]:
    """Characters, lines, whether there is a tab, the first 1000 characters."""
    text = F.coalesce(raw, F.lit(""))
    return {"chars": F.length(text), "lines": F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n"))), "has_tab": text.contains("\t"), "preview": F.left(text, F.lit(1000))}


def sheet_label(parent: str, sub: str, pos: str) -> Column:
    """101 for a row, 101.2 for a sub row."""
    return F.when(F.col(parent).isNotNull(), F.concat_ws(".", F.col(parent).cast("string"), F.col(sub).cast("string"))).otherwise(F.col(pos).cast("string"))


# Names and columns of the workbook's sheets, in order.
SHEETS = {
    "Inspection": ("pos", "char_type", "nominal", "upper_tol", "lower_tol"),
    "Marks": ("pos", "text_en", "text_de"),
    "Notes": ("label", "text_en", "text_de"),
    "Title Block": ("label_en", "label_de", "value"),
}


def workbook(chars: DataFrame, notes: DataFrame | None = None, marks: DataFrame | None = None, title: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sheet name to frame, the first always, the others if they have rows. Inspection is by pos, notes in source order."""
    out = {"Inspection": chars.orderBy("pos").select(*SHEETS["Inspection"])}
    if marks is not None and not marks.isEmpty():
        out["Marks"] = marks.orderBy("ord").select(*SHEETS["Marks"])
    if notes is not None and not notes.isEmpty():
        out["Notes"] = notes.orderBy("ord").withColumn("label", sheet_label("parent_pos", "sub_index", "pos")).select(*SHEETS["Notes"])
    if title is not None and not title.isEmpty():
        out["Title Block"] = title.select(*SHEETS["Title Block"])
    return out


# The two header rows of the inspection sheet, German above English.
INSPECTION_HEADER = (
    ("Pos.", "Merkmal", "Nennmaß", "O-TOL", "U-TOL"),
    ("Pos.", "Characteristic", "Nominal value", "Upper-tol", "Lower-tol"),
)


def headed(inspection: DataFrame) -> DataFrame:
    """The inspection sheet as text, with its header rows on top: line (1, 2, then 3 for all rows), pos (null in headers) and the columns c0 to c4."""
    spark, names = inspection.sparkSession, SHEETS["Inspection"]
    top = spark.createDataFrame([(k, None, *row) for k, row in enumerate(INSPECTION_HEADER, 1)], "line int, pos long, " + ", ".join(f"c{k} string" for k in range(len(names))))
    return top.unionByName(inspection.select(F.lit(3).alias("line"), F.col("pos").cast("long").alias("pos"), *(F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(names))))


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder for each sheet, as CSV: the inspection sheet below its two header rows, by pos, the others below their columns' names. A workbook is one drawing's, so a sheet is one file."""
    for name, frame in sheets.items():
        plain = name != "Inspection"
        one = frame.coalesce(1) if plain else headed(frame).repartition(1).sortWithinPartitions("line", "pos").drop("line", "pos")
        one.write.mode("overwrite").option("header", plain).csv(f"{path}/{name.replace(' ', '_')}")


def summary(chars: DataFrame, duplicates: DataFrame) -> DataFrame:
    """A row for each page: rows, kinds, rows to review, low confidence, probable duplicates."""
    counted = chars.groupBy("page").agg(F.count("*").alias("characteristics"), F.count_distinct("kind").alias("kinds"), F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("conf") < 60).alias("low_confidence"))
    return counted.join(duplicates.groupBy("page").agg(F.count("*").alias("duplicates")), "page", "left").fillna(0, ["duplicates"])


def payload(chars: DataFrame, notes: DataFrame, marks: DataFrame, title: DataFrame) -> DataFrame:
    """page and its four relations as one JSON text, each in order of ord: notes and marks are null where a page has none, title fields an empty list.
    Null fields are kept. A page is one drawing, so its lists are collected."""

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    both = listed(chars, "characteristics", "ord", "kind", "conf")
    for rows, name in ((notes, "notes"), (marks, "marks")):
        both = both.join(listed(rows, name, "ord", "pos", "text_en", "text_de"), "page", "left")
    fields = listed(title, "title_fields", "ord", "label", "label_en", "label_de", "value")
    both = both.join(fields, "page", "left").withColumn("title_fields", F.coalesce("title_fields", F.array().cast(fields.schema["title_fields"].dataType)))
    return both.select("page", F.to_json(F.struct("characteristics", "notes", "marks", "title_fields"), {"ignoreNullFields": "false"}).alias("payload"))
