"""Queries by name, each with its equivalent in ANSI SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tolmark.sources import carriers

Query = Callable[[SparkSession, str], DataFrame]


class Source:
    """The relations over one folder of base tables; ``source.dets`` reads the carrier of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in carriers.CARRIERS:
            raise AttributeError(name)
        return carriers.load(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of a Source under its own name."""

    def registered(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = carriers.ansi(sql)
        return f

    return registered
