"""Connected components of links that no one machine holds: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolmark.llm._tables import attach, cut


def _stars(e: DataFrame, total: int) -> DataFrame:
    """One large and one small star. e: u, v with v < u, distinct; total rows. A node with many links is a hot group."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("size")).select("x", F.least("x", "m").alias("m"), "size")
    large = attach(both, least, ["x"], "size", 2 * total).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    large = cut(large, "large")
    parent = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    moved = attach(large, parent, ["u"], "size", 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(parent.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached), for every node that is not the smallest of its component.

    links: two columns of ids in either order; nulls and links from a node to itself don't count. Each round is a written
    table, so that lineage stays short. Rounds grow with the logarithm of the longest chain.
    """
    e = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e, "links")
    seen = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if tuple(now) == seen or now.n == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # a star of stars is done: every node has one parent, and no parent has a parent
        if seen and e.groupBy("u").count().where("count > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(now)
        e = cut(_stars(e, now.n), "stars")
