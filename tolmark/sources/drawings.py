"""Page images as relations: binary files, and rows that clients send back as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A reviewed row as a client posts it.
ROW = "id STRING, pos INT, char_type STRING, nominal STRING, upper_tol STRING, lower_tol STRING, raw_text STRING, confidence DOUBLE, kind STRING, subtype STRING, source STRING, needs_review BOOLEAN, reviewed BOOLEAN, review_reasons ARRAY<STRING>, balloon_xy ARRAY<DOUBLE>, target_region ARRAY<DOUBLE>, note_ref_pos INT"


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """page (a hash of the path), path, image."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.xxhash64("path").alias("page"), "path", F.col("content").alias("image"))


def landing(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """The same as a stream of new files."""
    schema = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.xxhash64("path").alias("page"), "path", F.col("content").alias("image"))


def posted(df: DataFrame, body: str = "body") -> DataFrame:
    """Rows of export requests ({"rows": [...]}); a body that is no such object gives none."""
    parsed = F.from_json(F.col(body), f"rows ARRAY<STRUCT<{', '.join(p.strip().replace(' ', ': ', 1) for p in ROW.split(', '))}>>")
    return df.select(F.inline(F.coalesce(parsed["rows"], F.array().cast(f"ARRAY<STRUCT<{', '.join(p.strip().replace(' ', ': ', 1) for p in ROW.split(', '))}>>"))))
