"""Benchmark decontamination: documents that hold short test items, however long the documents are.

Words are runs of letters and digits, in lower case; a document's and an item's set are their distinct shingles of five
words. An item with one to four words is one shingle of its own width, and is looked for at that width. An item is in
a document if at least ``num / den`` of its shingles are.

Ordinary banded MinHash finds sets of like size; a short item in a long document has next to no Jaccard similarity with
it. So the search is on containment, with a bottom-k MinHash signature of the items alone: items are partitioned by size (powers of
two), and the m smallest hashes of an item's shingles stand for it, where m is one more than the shingles that the largest item of
the partition may lack. An item that is contained therefore shares a sample with the document for certain: nothing is lost.
A document must also have as many shingles as the item needs. Candidates are confirmed on the shingles' own words.

All of it is DataFrame functions. The items' signatures are broadcast if they are few, else joined by shuffle; of the documents
only ids of candidates are shuffled.

Defined results: null texts and texts without words hold nothing and are held by nothing. Rows without doc_id or item_id
are left out. Rows that repeat an id count together, as the row that shares most. An empty table on either side gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tolmark.llm._tables import BROADCAST_ROWS, cut, table

WIDTH, NUM, DEN = 5, 80, 100
#: Characters of the items' shingles that may be broadcast.
BROADCAST_CHARACTERS = 1 << 24


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(w: Column, width: int) -> Column:
    """The begins of all shingles of this width, from 1; none if the text is shorter."""
    return F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - width + 1)).otherwise(F.array().cast("array<int>"))


def _hashes(w: Column, width: int) -> Column:
    return F.transform(_windows(w, width), lambda at: F.xxhash64(F.slice(w, at, width)))


def _shingles(w: Column, width: Column) -> Column:
    """The distinct shingles themselves."""
    starts = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.array_join(F.slice(w, at, width), " ")))


def signatures(items: DataFrame, key: str, text: str, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """item, width, n (shingles), need (shingles that a document must share), parts (the shingles), signature (hashes)."""
    w = words(F.col(text))
    slim = items.select(F.col(key).cast("long").alias("item"), w.alias("w")).where("item IS NOT NULL AND size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(width)))
    sized = slim.withColumn("parts", _shingles(F.col("w"), F.col("width"))).withColumn("n", F.size("parts").cast("long")).withColumn("need", F.expr(f"({num} * n + {den} - 1) div {den}"))
    largest = F.expr("cast(pow(2, floor(log2(n)) + 1) as bigint) - 1")  # of the partition
    lacking = F.expr(f"({den - num} * largest) div {den}")
    hashes = F.array_sort(F.transform("parts", lambda x: F.xxhash64(F.split(x, " "))))
    return sized.withColumn("largest", largest).withColumn("signature", F.slice(hashes, 1, (lacking + 1).cast("int"))).drop("w", "largest")


def contained(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc, item, n (the item's shingles), shared (those in the document): a row for each pair that holds."""
    signed = cut(signatures(items, item_key, item_text, width, num, den), "signatures")
    samples = signed.select("item", "width", "need", F.explode("signature").alias("hash"))
    widths = sorted(r.width for r in signed.select("width").distinct().collect()) or [width]  # at most `width` numbers
    few = samples.count() <= BROADCAST_ROWS

    slim = docs.select(F.col(key).cast("long").alias("doc"), words(F.col(text)).alias("w")).where("doc IS NOT NULL")
    parts = F.concat(*(_hashes(F.col("w"), k) for k in widths))
    probes = slim.select("doc", F.size("w").cast("long").alias("words"), F.explode(parts).alias("hash"))
    # a document has no more shingles of any width than words
    hit = probes.join(F.broadcast(samples) if few else samples, "hash").where("words >= need")
    candidates = cut(hit.select("doc", "item").distinct(), "candidates")
    suspects = slim.join(F.broadcast(candidates) if candidates.count() <= BROADCAST_ROWS else candidates, "doc")
    held = signed.drop("signature")
    characters = held.agg(F.sum(F.length(F.array_join("parts", " ")))).first()[0] or 0
    both = suspects.join(F.broadcast(held) if characters <= BROADCAST_CHARACTERS else held, "item")
    shared = F.size(F.array_intersect(_shingles(F.col("w"), F.col("width")), F.col("parts"))).cast("long")
    found = both.select("doc", "item", "n", "need", shared.alias("shared")).where("shared >= need")
    return found.groupBy("doc", "item").agg(F.max("n").alias("n"), F.max("shared").alias("shared"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("item_shingles"), "shared")


SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS width, unnest(list_transform(range(1, len(w) - least(len(w), {WIDTH}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {WIDTH}) - 1], ' '))) AS x
  FROM b WHERE len(w) > 0
), sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM items),
parts AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS x
  FROM d CROSS JOIN widths WHERE len(w) >= width
), shared AS (SELECT doc_id, item_id, count(*) AS shared FROM parts JOIN items USING (width, x) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS item_shingles, shared FROM shared JOIN sizes USING (item_id) WHERE {DEN} * shared >= {NUM} * n
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": SQL}
