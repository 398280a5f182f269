"""Exact top-k search by inner product, with MaxScore over postings of dimensions.

Vectors become whole numbers, ``floor(scale * x)``. A dimension is a term, a candidate's value in it the posting's weight, and a query
multiplies it by its own. Candidates are dealt into shards. A shard's task reads its candidates
once, holds their postings by dimension while the queries stream past, and for each query

1. scores the shard's first candidates in full, which gives the score to beat (the k-th best so far),
2. orders the query's terms by their upper bound in this shard (largest or smallest posting, by the query's sign); the
   smallest bounds that together do not reach the score to beat are the non-essential terms,
3. adds up the essential terms' postings for all candidates, and probes the others, largest bound first, for those
   candidates whose sum and remaining bound still reach the score to beat.

Ties are kept until the end: the k best of each shard, then of all shards, by score and then smaller vec_id. Sums are exact:
floats are used only while bounds show that every sum is a whole number that they hold.

Defined results: vectors that are null or hold a null or non-finite component, and rows without vec_id, take no part. A shorter
vector counts as having zeros at its end. Rows that repeat a vec_id are candidates each; a query's own id is never its
candidate, and equal queries give their result once. Scores must stay under 2^63, and so must ``scale * x``: beyond, they are undefined. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tolmark.llm._tables import cut, table

#: Candidates of a shard, and queries that are answered at a time.
SHARD, BLOCK = 65_536, 2_048
#: Candidates that are scored in full first, and terms that are probed at a time.
SEED, PROBE = 512, 8


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row for each list, with zeros at the end of shorter ones."""
    flat = column.combine_chunks()
    out = np.zeros((len(flat), width), np.int64)
    sizes = np.diff(flat.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy()
    return out


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The indices of the k best by score, then smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids = ids
        top = int(np.abs(vectors).max(initial=0))
        self.top, self.whole = top, vectors
        self.postings = {np.int64: np.ascontiguousarray(vectors.T)}
        self.high, self.low = vectors.max(axis=0), vectors.min(axis=0)

    def _as(self, query: np.ndarray) -> type:
        """The smallest type that holds every partial sum exactly."""
        total = float(np.abs(query).astype(float).sum()) * self.top
        return np.float32 if total < 2**24 else np.float64 if total < 2**53 else np.int64

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than the query itself."""
        kind = self._as(query)
        if kind not in self.postings:
            self.postings[kind] = self.postings[np.int64].astype(kind)
        postings, q = self.postings[kind], query.astype(kind)
        other = self.ids != own
        first = np.flatnonzero(other[: SEED + k])
        beat = None
        if len(first) >= k:
            seen = q @ postings[:, first]
            beat = np.partition(seen, len(seen) - k)[len(seen) - k]
        bound = np.maximum(query * self.high, query * self.low)
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        cut_at = 0 if beat is None else int(np.searchsorted(below, beat, side="left")) if (bound >= 0).all() else self._prefix(below, beat)
        rest, essential = order[:cut_at], order[cut_at:]
        score = q[essential] @ postings[essential] if len(essential) else np.zeros(len(self.ids), kind)
        left = bound[rest].sum()
        alive = np.flatnonzero(other if beat is None else other & (score + kind(left) >= beat))
        score = score[alive]
        for s in range(len(rest), 0, -PROBE):
            probed = rest[max(0, s - PROBE) : s]
            score = score + q[probed] @ postings[np.ix_(probed, alive)]
            left -= bound[probed].sum()
            keep = score + kind(left) >= beat
            alive, score = alive[keep], score[keep]
        at = best_of(score, self.ids[alive], k)
        return self.ids[alive[at]], score[at].astype(np.int64)

    @staticmethod
    def _prefix(below: np.ndarray, beat: float) -> int:
        """Bounds may be negative: the longest prefix whose sum stays under the score to beat."""
        under = np.flatnonzero(below < beat)
        return int(under[-1]) + 1 if len(under) else 0


def integers(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, v (array of long) of the rows that take part."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. Both sides: id, v. A shard's task reads its candidates once, then the queries one batch after another."""
    candidates, queries = cut(candidates, "candidates"), cut(queries.dropDuplicates(["id", "v"]), "queries")
    n = candidates.count()
    spread = min(candidates.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK))  # few candidates still keep the cores busy
    shards = max(-(-n // SHARD), spread, 1)
    own = candidates.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "id", "v")
    ordered = own.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for b in batches:
            place, role, ids = (b.column(c).to_numpy() for c in range(3))
            change = np.flatnonzero((np.diff(place) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *change], [*change, b.num_rows]):
                if place[s] != at:
                    at, parts, shard = place[s], [], None
                vectors = pa.chunked_array([b.column(3).slice(s, e - s)])
                if role[s] == 0:
                    parts.append((ids[s:e], matrix(vectors, _width(vectors))))
                    continue
                if shard is None and parts:
                    shard, parts = Shard(np.concatenate([p[0] for p in parts]), _stacked([p[1] for p in parts])), []
                for t in range(s, e, BLOCK) if shard is not None else ():
                    yield _found(shard, ids[t : min(e, t + BLOCK)], vectors.slice(t - s, BLOCK), k)

    found = ordered.mapInArrow(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _width(vectors: pa.ChunkedArray) -> int:
    return int(pc.max(pc.list_value_length(vectors)).as_py() or 0)


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of several widths as one matrix, with zeros at the end of shorter ones."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _found(shard: Shard, ids: np.ndarray, vectors: pa.ChunkedArray, k: int) -> pa.RecordBatch:
    """The shard's k best of each query. Components that only one side has count nothing."""
    wide = shard.whole.shape[1]
    asked = matrix(vectors, max(wide, _width(vectors)))[:, :wide]
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
    for own, query in zip(ids, asked):
        near, score = shard.search(own, query, k)
        for held, part in zip(out, (np.full(len(near), own), near, score)):
            held.append(part)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return search(whole, whole.where("id % 20 = 0"), 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op4_top_k": op4_top_k}
ORACLES = {"op4_top_k": SQL}
