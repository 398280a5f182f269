"""Registered queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tolmark.plans import blocks, boxes, registry, sessions, texts  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.flagship(registry.Source(spark, sf_dir))
