"""From raw documents to tokens: quality, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
docs, whatever these are called beside doc_id and text (and lang, for quality); names that the operators use inside don't clash. A
document is known by doc_id: rows that share one fall or stay together; rows without one always stay. Repeated rows stay
repeated, an empty table stays empty, and very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tolmark.llm import bpe, decontam, line_dedup, near_dup, quality
from tolmark.llm._tables import BROADCAST_ROWS, cut, table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs whose doc_id is not among gone (doc)."""
    gone = cut(gone.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts stay, as do all texts of a language without trusted documents, and everything if
    labels are empty; null lang is a language. Equal scores are judged alike."""
    found = quality.judged(docs, "doc_id", "text", "lang", table(spark, sf_dir, "labels"))
    return _without(docs, found.where("NOT kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but the largest doc_id. Null text counts as one empty line and so becomes ''. Where docs has
    n_chars, it is counted anew."""
    kept = line_dedup.dedup_lines(docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays. Null texts and texts without words are in no group."""
    return _without(docs, near_dup.near_groups(docs, "doc_id", "text", words=5, num=80, den=100).where("doc <> component"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null texts and texts without words hold none; nothing goes if benchmark is empty."""
    return _without(docs, decontam.contained(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: a row for each row of docs. Null and empty texts have no tokens."""
    return bpe.encode(docs, "doc_id", "text").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("encoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The quality model and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
