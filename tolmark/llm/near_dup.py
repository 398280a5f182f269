"""Near-duplicate groups: banded MinHash, odd sketches, exact confirmation.

A document's set holds its distinct shingles of n words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer words, the whole
sequence as one). Two documents are linked if ``intersection / union >= similarity``, as integers; linked groups are the
components of these links.

1. One pass over the texts makes each set's MinHash samples, their band keys and an odd sketch: every sample toggles one
   bit of a bitmap, so that the bits set in the XOR of two bitmaps count the samples that differ, which is precise where sets are
   much alike. Equal sets form a class; from here on its smallest doc_id stands for it.
2. In each bucket of a band, every member is paired with the smallest one. Pairs whose sizes or XOR counts rule out
   the similarity go; the count is set so that a true pair is lost with a probability under 1e-9.
3. The pairs left are confirmed on full sets, built again from whole texts, in a stream that holds one hub's set.
4. Components of the links. Where a bucket still holds several components, its members are compared block against block,
   by sketch and then on full sets, with only those of other components; within one there is nothing more to learn. So every
   pair that shares a bucket is confirmed, ruled out by its sketch, or already in one group, and no pair of a
   group is written down for being in it.

The number of bands is such that a pair at the very threshold shares none with a probability under 1e-7.
Sets are of 64-bit hashes.

Defined results: null or empty text, or one without words, has an empty set and is linked with nothing. A row
without doc_id is linked with nothing (its component is null, and it is kept). Rows that repeat a doc_id are judged by their own
text and are one node for links. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tolmark.llm import _shingles
from tolmark.llm._components import components
from tolmark.llm._tables import BROADCAST_ROWS, attach, cut, table

_U = np.uint64
#: Bits of an odd sketch, as words.
SKETCH_WORDS = 8
#: Members that one task confirms against a copy of their hub.
AGAINST_ONE = 256
#: Shingles in a block of a bucket that holds several components.
BLOCK_ITEMS = 400_000


def banding(similarity: float, lost: float = 1e-7) -> tuple[int, int]:
    """Bands and rows: about as many rows as leave 26 bands or so, and enough bands to lose fewer than so many pairs at the threshold."""
    rows = max(1, round(log(0.42) / log(similarity)))
    return int(np.ceil(log(lost) / log(1 - similarity**rows))), rows


@cache
def sketch_limit(samples: int, similarity: float, lost: float = 1e-9) -> int:
    """The most bits in the XOR of two odd sketches at this similarity or more, but for a share of lost."""
    bits = 64 * SKETCH_WORDS
    odd = np.zeros(bits + 1)
    odd[0] = 1.0
    size = np.arange(bits + 1)
    total = np.zeros(bits + 1)
    for differing in range(samples + 1):
        total += odd * comb(samples, differing) * (1 - similarity) ** differing * similarity ** (samples - differing)
        for _ in range(2):  # the sample of one set, then that of the other
            step = np.zeros(bits + 1)
            step[1:] += odd[:-1] * (bits - size[:-1]) / bits
            step[:-1] += odd[1:] * size[1:] / bits
            odd = step
    return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > lost).max())


class MinHash:
    def __init__(self, bands: int, rows: int) -> None:
        r = np.random.default_rng(77)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.flip = r.integers(0, 1 << 63, n, dtype=_U)[:, None] * _U(2)
        self.times = r.integers(0, 1 << 63, n, dtype=_U)[:, None] * _U(2) + _U(1)
        self.place = r.integers(0, 1 << 63, n, dtype=_U)
        self.band = r.integers(0, 1 << 63, bands, dtype=_U)

    def samples(self, items: np.ndarray) -> np.ndarray:
        out = None
        for s in range(0, len(items), 2048):
            with np.errstate(over="ignore"):
                part = ((items[None, s : s + 2048] ^ self.flip) * self.times).min(axis=1)
            out = part if out is None else np.minimum(out, part)
        return out

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Of a row of samples for each document: SKETCH_WORDS words each."""
        bits = 64 * SKETCH_WORDS
        at = (_shingles.mix(samples ^ self.place) % _U(bits)).astype(np.int64) + np.arange(len(samples))[:, None] * bits
        odd = np.bincount(at.ravel(), minlength=len(samples) * bits).reshape(len(samples), bits) & 1
        return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)

    def keys(self, samples: np.ndarray) -> np.ndarray:
        by_band = samples.reshape(len(samples), self.bands, self.rows)
        out = np.tile(self.band, (len(samples), 1))
        for k in range(self.rows):
            with np.errstate(over="ignore"):
                out = _shingles.mix(out * _shingles._PLACE[0] + by_band[:, :, k])
        return out.view(np.int64)


_WORDS = [f"s{k}" for k in range(SKETCH_WORDS)]


def signatures(df: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc, n (set size), k0 and k1 (a 128-bit digest of the set), s0 ... (odd sketch), bands (keys; null for an empty set). No shuffle."""
    schema = f"doc long, n long, k0 long, k1 long, {', '.join(f'{s} long' for s in _WORDS)}, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = MinHash(bands, rows)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                n, digests, samples = [], [], []
                for items in _shingles.sets(part.column(1), words):
                    n.append(len(items))
                    with np.errstate(over="ignore"):
                        digests.append((items.sum(dtype=_U), _shingles.mix(items ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)))
                    samples.append(hashed.samples(items) if len(items) else np.zeros(bands * rows, _U))
                digests, samples = np.array(digests, _U).view(np.int64), np.array(samples, _U)
                sketch, keys = hashed.sketch(samples), hashed.keys(samples)
                ends = np.arange(len(n) + 1, dtype=np.int32) * bands
                empty = pa.array([x == 0 for x in n])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(ends), lists.values, mask=empty)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), *(pa.array(sketch[:, k].copy()) for k in range(SKETCH_WORDS)), lists], names=["doc", "n", "k0", "k1", *_WORDS, "bands"])

    return df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def _may_be_alike(num: int, den: int, samples: int) -> F.Column:
    """On the columns n, s0 ... of both sides, prefixed a_ and b_."""
    differ = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _WORDS), F.lit(0))
    sizes = den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")
    return sizes & (differ <= sketch_limit(samples, num / den))


def _named(df: DataFrame, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(side if c == "rep" else f"{side}_{c}") for c in df.columns if c not in keep))


def _reaches(one: np.ndarray, other: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have the similarity."""
    if not len(one):
        return False
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    common = int((one[at] == other).sum())
    return common > 0 and den * common >= num * (len(one) + len(other) - common)


def confirmed(pairs: DataFrame, df: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. A hub's text goes once to every AGAINST_ONE of its partners or so."""
    groups = pairs.groupBy("a").agg(F.count("*").alias("size"), F.ceil(F.count("*") / AGAINST_ONE).cast("int").alias("copies"))
    hubs = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("role"), F.col("a").alias("doc"))
    others = attach(pairs, groups, ["a"], "size", pairs.count()).select("a", F.pmod(F.hash("b"), "copies").alias("copy"), F.lit(1).alias("role"), F.col("b").alias("doc"))
    roles = cut(hubs.unionByName(others), "roles")
    texts = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    few = roles.count() <= BROADCAST_ROWS
    rows = texts.join(F.broadcast(roles) if few else roles, "doc").select("a", "copy", "role", "doc", "text")
    ordered = rows.repartition("a", "copy").sortWithinPartitions("a", "copy", "role", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets = None, []  # a doc_id on several rows has several sets
        for b in batches:
            found: list[tuple[int, int]] = []
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                columns = (part.column(k).to_pylist() for k in range(4))
                for a, copy, role, doc, mine in zip(*columns, _shingles.sets(part.column(4), words)):
                    if role == 0:
                        hub, sets = (a, copy), [*(sets if hub == (a, copy) else []), mine]
                    elif hub == (a, copy) and any(_reaches(items, mine, num, den) for items in sets):
                        found.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return cut(ordered.mapInArrow(run, "a long, b long"), "confirmed")


def across(rest: DataFrame, reps: DataFrame, df: DataFrame, key: str, text: str, words: int, num: int, den: int, limit: int) -> DataFrame:
    """Links (a, b) between members of different components of a bucket: enough of them to join what they join.

    rest: bucket, rep, component. A bucket is dealt into blocks of about BLOCK_ITEMS shingles; a task holds two of them with their
    sets, and goes on only with pairs whose components it has not yet found linked. A pair is looked at in the first band that it
    shares, by size and sketch, then on full sets; links alone leave the task, fewer than its documents.
    """
    members = rest.select("rep").distinct()
    few = members.count() <= BROADCAST_ROWS
    texts = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(F.broadcast(members) if few else members, "rep", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                found = list(_shingles.sets(part.column(1), words))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["rep", "items"])

    whole = cut(texts.mapInArrow(sets, "rep long, items array<long>"), "sets")
    blocks = rest.join(reps.select("rep", "n"), "rep").groupBy("bucket").agg(F.count("*").alias("size"), F.ceil(F.sum("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    placed = attach(rest, cut(blocks, "sizes"), ["bucket"], "size", rest.count()).withColumn("own", F.pmod(F.hash("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("rep", "bucket", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    held = placed.join(reps.select("rep", *_WORDS, "bands"), "rep").join(whole, "rep")

    def task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, own, component = (group[c].to_numpy().copy() for c in ("rep", "own", "component"))
        sketch = np.stack([group[c].to_numpy() for c in _WORDS], axis=1).view(_U)
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        band = int(np.flatnonzero(bands[0] == group["bucket"][0].as_py())[0])
        lists = group["items"].combine_chunks()
        begin, size = lists.offsets.to_numpy(), np.diff(lists.offsets.to_numpy())
        names, items = np.unique(lists.values.to_numpy(), return_inverse=True)
        marked = np.zeros(len(names), bool)
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        links: list[tuple[int, int]] = []
        for a in np.flatnonzero(own == low):
            may = (component != component[a]) & (den * np.minimum(size, size[a]) >= num * np.maximum(size, size[a]))
            may &= (own == high) if low < high else np.arange(len(node)) > a
            if band:
                may &= ~(bands[:, :band] == bands[a, :band]).any(axis=1)
            some = np.flatnonzero(may)
            some = some[np.bitwise_count(sketch[some] ^ sketch[a]).sum(axis=1) <= limit]
            if not len(some):
                continue
            mine = items[begin[a] : begin[a + 1]]
            marked[mine] = True
            for b in some:
                if component[b] != component[a]:
                    common = int(marked[items[begin[b] : begin[b + 1]]].sum())
                    if den * common >= num * (len(mine) + int(size[b]) - common):
                        links.append((int(node[a]), int(node[b])))
                        component[component == component[b]] = component[a]
            marked[mine] = False
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return cut(held.groupBy("bucket", "low", "high").applyInArrow(task, "a long, b long"), "across")


def near_groups(df: DataFrame, key: str, text: str, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc, n_shingles, component: a row for each row of df. Similarity is num / den."""
    bands, rows = banding(num / den)
    signed = cut(signatures(df, key, text, words, bands, rows), "signatures")
    total = signed.count()
    shared = signed.where("n > 0 AND doc IS NOT NULL").groupBy("k0", "k1").agg(F.min("doc").alias("rep"), F.count("*").alias("size")).where("size > 1")
    shared = cut(shared, "classes")
    of_class = attach(signed.select("doc", "k0", "k1"), shared, ["k0", "k1"], "size", total).where("doc <> rep").select("doc", "k0", "k1", "rep").distinct()
    of_class = cut(of_class, "copies")
    side = F.broadcast if of_class.count() <= BROADCAST_ROWS else (lambda x: x)
    first = signed.join(side(of_class), ["doc", "k0", "k1"], "left").withColumn("own", F.col("rep").isNull() & (F.col("n") > 0) & F.col("doc").isNotNull())
    nodes = first.select("doc", "n", F.coalesce("rep", "doc").alias("rep"), *(F.when(F.col("own"), F.col(c)).alias(c) for c in (*_WORDS, "bands")))
    nodes = cut(nodes, "nodes")
    reps = nodes.where("bands IS NOT NULL")
    held = reps.select("rep", "n", *_WORDS)

    placed = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = cut(placed.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    hits = cut(attach(placed, shared, ["bucket"], "size", total * bands), "hits")

    alike = _may_be_alike(num, den, bands * rows)
    stars = hits.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = cut(stars, "pairs")
    hubs = stars.groupBy("a").agg(F.count("*").alias("size")).join(_named(held, "a"), "a")
    stars = attach(stars, cut(hubs, "hubs"), ["a"], "size", stars.count()).join(_named(held, "b"), "b").where(alike).select("a", "b").distinct()
    links = confirmed(cut(stars, "stars"), df, key, text, words, num, den)
    # an id on several rows, of which some are copies of others: it is one node
    selves = nodes.where("rep = doc").join(side(of_class), "doc", "left_semi").select("doc")
    several = of_class.groupBy("doc").count().where("count > 1").select("doc")
    bridges = of_class.join(selves.unionByName(several).distinct(), "doc", "left_semi").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    links = cut(links.unionByName(bridges), "links")
    found = components(links)

    wide = hits.where("size > 2").join(found, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "hub", F.coalesce("component", "rep").alias("component"))
    wide = cut(wide, "wide")
    mixed = wide.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size")
    rest = cut(attach(wide, cut(mixed, "mixed"), ["bucket"], "size", wide.count()).where("rep <> hub").select("bucket", "rep", "component"), "rest")
    more = across(rest, reps, df, key, text, words, num, den, sketch_limit(bands * rows, num / den))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    out = nodes.select("doc", "n", "rep").join(found, F.col("rep") == F.col("node"), "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, num=85, den=100)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM cut
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

QUERIES = {"op1_near_dup": op1_near_dup}
ORACLES = {"op1_near_dup": SQL}
