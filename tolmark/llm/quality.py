"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over n-grams of up to ORDER code points, each text being preceded by ORDER - 1 begin symbols. Nothing bounds its
size: counts, contexts and scores are tables that grow with the corpus and are joined by n-gram, sharded.

1. One pass packs the documents into blocks of about BLOCK characters (a longer text goes over several, with its context) and lists
   each block's distinct n-grams, with how often they occur in trusted documents (labelled quality 1 and not toxic, in every
   label they have). One trusted document in CALIBRATION, by a hash of doc_id, is left out of the counts. The lists are dealt by
   n-gram into shards of about SHARD entries, each of which gives its distinct n-grams and their counts.
2. Continuation counts, discounts and back-off weights of the lower orders are aggregations of these counts.
3. The distinct n-grams of all blocks get their probabilities by joins with counts, contexts and shorter n-grams, from order 1 up.
4. The scores go back to the blocks by way of the shards: a common n-gram is asked for once by each block, so no key is hot. A second pass
   packs the texts again, into the same blocks, and a task holds one block and its scores and gives its documents' sums, which are
   added up by document. Texts are shuffled once, compressed, and never written: both passes read the same files in the same
   splits (see _settled), and a block whose texts differ between them fails the job.
5. A document's score is its log perplexity as if PRIOR more symbols had scored like the average left-out trusted symbol of its
   language, since a text of a few words says little. A language's threshold is the QUANTILE of its trusted scores: that of a normal
   distribution with the mean and variance of its left-out scores, where the variance counts POOL more documents with the pooled variance
   of all languages, and sqrt(1 + 1 / n) allows for the mean of n documents being an estimate. Plain order statistics of a
   handful of documents can't show a far quantile; this rule is the same for any number of them. A document above the threshold is
   rejected; those of a language without a left-out trusted document are kept.

Discounts outside [LEAST, k] are set to the nearer end, so that every back-off weight is positive and so is every
probability; a discount whose counts of counts are missing is k / 2. Unknown code points share the probability of one more symbol.

Defined results: null and empty texts have no perplexity and are kept, as is every document if nothing is trusted (its perplexity
is then 1). NUL counts as U+FFFD. Null lang is a language of its own. Rows without doc_id are judged, never trusted. Rows that
repeat a doc_id are judged one by one, and count once for each row. Very long texts are scored whole. Labels with nulls don't make a document trusted.
Equal scores are judged alike: a score equal to the threshold is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tolmark.llm._shingles import mix
from tolmark.llm._tables import BROADCAST_ROWS, cut, table

ORDER = 5
CALIBRATION, QUANTILE, PRIOR, POOL, LEAST = 4, 0.999, 200, 30, 0.1
#: Characters of a block; characters that are hashed at once.
BLOCK, AT_ONCE = 1 << 23, 1 << 20
#: N-grams of blocks that go to one shard, about.
SHARD = 2_000_000
BEGIN = "\0"

_U = np.uint64
_TIMES = np.random.default_rng(31).integers(0, 1 << 63, ORDER, dtype=_U) * _U(2) + _U(1)


def _hashes(points: np.ndarray) -> np.ndarray:
    """Of the n-gram that starts at each code point but the last ORDER - 1."""
    mixed, n = mix(points.astype(_U) + _U(77)), len(points) - ORDER + 1
    with np.errstate(over="ignore"):
        return sum((mixed[k : n + k] * _TIMES[k] for k in range(1, ORDER)), mixed[:n] * _TIMES[0])


def coded(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as rows of code points in the order of their hashes, and the number of the n-gram at each position of the parts in turn. Each part
    that isn't empty starts with ORDER - 1 characters of context. The same parts always give the same numbers."""
    hashes, windows, codes, at = [], [], [], 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= AT_ONCE):
            size += len(parts[to])
            to += 1
        own = [p for p in parts[at:to] if p]
        at = to
        if not own:
            continue
        points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        hashed = _hashes(points)
        inner = np.ones(len(hashed), bool)
        ends = np.cumsum([len(p) for p in own])[:-1]
        inner[(ends[:, None] - np.arange(1, ORDER)).ravel()] = False
        places = np.flatnonzero(inner)
        found = pa.array(hashed[places]).dictionary_encode()
        code = found.indices.to_numpy()
        first = np.empty(len(found.dictionary), np.int64)
        first[code[::-1]] = places[::-1]
        hashes.append(found.dictionary.to_numpy())
        windows.append(points[first[:, None] + np.arange(ORDER)])
        codes.append(code)
    if not codes:
        return np.empty((0, ORDER), np.uint32), np.empty(0, np.int32)
    _, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    offsets = np.cumsum([0, *map(len, hashes)])
    return np.concatenate(windows)[first], np.concatenate([number.astype(np.int32)[o + c] for o, c in zip(offsets, codes)])


def _settled(df: DataFrame) -> DataFrame:
    """df, or a written copy of it where a second run of its plan could deal its rows otherwise: beyond a shuffle, or in splits
    that follow from the number of cores at hand."""
    spark = df.sparkSession
    splits = "spark.sql.files.minPartitionNum"
    if spark.conf.get(splits, None) is None:
        spark.conf.set(splits, spark.sparkContext.defaultParallelism)
    return cut(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def _packed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[int, list[tuple]]]:
    """The number of each block of a partition, and its parts: row, doc, lang, text with its context, and what else the batches hold."""
    number = rows = TaskContext.get().partitionId() << 40
    held, size = [], 0
    for b in batches:
        for s in range(0, b.num_rows, 256):
            for doc, lang, text, *more in zip(*(c.to_pylist() for c in b.slice(s, 256).columns)):
                whole = BEGIN * (ORDER - 1) + text.replace(BEGIN, "\ufffd") if text else ""
                for a in range(0, max(len(whole) - ORDER + 1, 1), AT_ONCE):
                    part = whole[a : a + AT_ONCE + ORDER - 1]
                    held.append((rows, doc, lang, part, *more))
                    size += len(part) + 16  # empty texts take room too
                    if size >= block:
                        yield number, held
                        number, held, size = number + 1, [], 0
                rows += 1
    if held:
        yield number, held


def _text(held: list[tuple]) -> tuple[bytes, int]:
    """The parts of a block as one, and its digest."""
    joined = "".join([x[3] for x in held]).encode()
    return joined, xxhash.xxh3_64_intdigest(joined) >> 1


def _strings(joined: bytes) -> pa.StringArray:
    """N-grams from their concatenation."""
    data = np.frombuffer(joined, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)[::ORDER]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(joined))


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def _plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def listed(df: DataFrame, block: int) -> DataFrame:
    """df: doc, lang, text, fit (boolean). A row for each block: block, digest, n, grams (n distinct ones in the order of coded(), as one
    compressed string), fitted (how often each occurs in fit documents, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _packed(batches, block):
            windows, codes = coded([x[3] for x in held])
            grams = windows.astype("<u4").tobytes().decode("utf-32-le").encode()
            marked = np.repeat([bool(x[4]) for x in held], [max(len(x[3]) - ORDER + 1, 0) for x in held])
            fitted = np.bincount(codes[marked], minlength=len(windows)).astype(np.int32)
            values = [number, _text(held)[1], len(windows), _squeezed(grams), _squeezed(fitted.tobytes())]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "digest", "n", "grams", "fitted"])

    return df.select("doc", "lang", "text", "fit").mapInArrow(run, "block long, digest long, n long, grams binary, fitted binary")


def texts(df: DataFrame, block: int) -> DataFrame:
    """A row for each block that listed() gives: block, digest, row, doc, lang, size (of each part, in characters), texts (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _packed(batches, block):
            joined, digest = _text(held)
            row, doc, lang, parts = map(list, zip(*held))
            values = [number, digest, row, doc, lang, [len(p) for p in parts], _squeezed(joined)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "digest", "row", "doc", "lang", "size", "texts"])

    return df.select("doc", "lang", "text").mapInArrow(run, "block long, digest long, row array<long>, doc array<long>, lang array<string>, size array<int>, texts binary")


def dealt(lists: DataFrame, shards: int) -> DataFrame:
    """shard, home (the block), digest, at (the place of the first in the block's list), grams, fitted: each block's list in slices by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for home, digest, grams, fitted in zip(*(c.to_pylist() for c in b.columns)):
                grams, fitted = _plain(grams), _plain(fitted)
                points = np.frombuffer(grams.decode().encode("utf-32-le"), np.uint32)
                own = (_hashes(points)[::ORDER] >> _U(32)) * _U(shards) >> _U(32) if len(points) else np.empty(0, _U)
                ends = np.searchsorted(own, np.arange(shards + 1, dtype=_U))  # the list is in the order of hashes
                offsets = np.frombuffer(_strings(grams).buffers()[1], np.int32)
                some = [k for k in range(shards) if ends[k] < ends[k + 1]] or [0]  # a block without n-grams still has to be told of
                rows = [(k, home, digest, int(ends[k]), _squeezed(grams[offsets[ends[k]] : offsets[ends[k + 1]]]), _squeezed(fitted[4 * ends[k] : 4 * ends[k + 1]])) for k in some]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "home", "digest", "at", "grams", "fitted"])

    return lists.select("block", "digest", "grams", "fitted").mapInArrow(run, "shard int, home long, digest long, at int, grams binary, fitted binary")


def counts(slices: DataFrame) -> DataFrame:
    """shard, gram, c: the distinct n-grams of all blocks, and how often each occurs in fit documents."""

    def task(group: pa.Table) -> pa.Table:
        found = _strings(b"".join([_plain(x) for x in group["grams"].to_pylist()])).dictionary_encode()
        fitted = np.frombuffer(b"".join([_plain(x) for x in group["fitted"].to_pylist()]), np.int32)
        c = np.bincount(found.indices.to_numpy(), fitted, len(found.dictionary)).astype(np.int64)
        return pa.table([pa.array(np.full(len(c), group["shard"][0].as_py(), np.int32)), found.dictionary, pa.array(c)], names=["shard", "gram", "c"])

    return slices.select("shard", "grams", "fitted").groupBy("shard").applyInArrow(task, "shard int, gram string, c long")


def _discounts(counted: DataFrame) -> DataFrame:
    """One row: d1, d2, d3 of modified Kneser-Ney."""
    n = counted.agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
    made = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.nullif(F.col(f"n{k}"), F.lit(0.0)))
        made.append(F.when(d.isNull(), k / 2).otherwise(F.least(F.greatest(d, F.lit(LEAST)), F.lit(float(k)))).alias(f"d{k}"))
    return n.select(*made)


def model(counted: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order: gram, c, less (its discount); and context, total, weight (of what is left to the order below)."""
    out = {}
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # continuation counts: how many symbols come before
            counted = counted.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))
        counted = cut(counted, f"counts{n}")
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = counted.crossJoin(F.broadcast(_discounts(counted))).select("gram", "c", less.alias("less"))  # one row
        sums = own.groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("c").alias("total"), F.sum("less").alias("taken"))
        out[n] = own, sums.select("context", "total", (F.col("taken") / F.col("total")).alias("weight"))
    return out


def scores(asked: DataFrame, orders: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """asked with p, the probability of each n-gram's last symbol after the others. asked: gram, distinct, and other columns that the model's tables don't have."""
    below = None
    for n in range(1, ORDER + 1):
        own, contexts = orders[n]
        grams = asked if n == ORDER else asked.select(F.substring("gram", ORDER - n + 1, n).alias("gram")).distinct()
        joined = grams.join(own, "gram", "left").withColumn("context", F.substring("gram", 1, n - 1))
        if below is None:  # the one context of order 1 is empty
            symbols = F.broadcast(own.agg((F.count("*") + 1).alias("symbols")))
            joined = joined.join(F.broadcast(contexts), "context", "left").crossJoin(symbols).withColumn("lower", 1.0 / F.col("symbols"))
        else:
            joined = joined.join(contexts, "context", "left").withColumn("suffix", F.substring("gram", 2, n - 1))
            joined = joined.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        seen = F.coalesce((F.col("c") - F.col("less")) / F.col("total"), F.lit(0.0))
        below = cut(joined.select(*grams.columns, (seen + F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p")), f"scores{n}")
    return below


def sums(packed: DataFrame, slices: DataFrame, scored: DataFrame) -> DataFrame:
    """doc, lang, cost (the sum of -log p over the text), n (symbols): a row for each row that was packed. scored: shard, gram, p."""

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        grams, p = known["gram"].combine_chunks(), known["p"].to_numpy().astype(np.float32)
        kept = [p[pc.index_in(_strings(_plain(x)), value_set=grams).to_numpy()].tobytes() if len(grams) else b"" for x in asked["grams"].to_pylist()]
        return pa.table([asked["home"], asked["digest"], asked["at"], pa.array(kept, pa.binary())], names=["home", "digest", "at", "p"])

    known = scored.select(F.col("shard").alias("part"), "gram", "p").groupBy("part")
    found = slices.select("shard", "home", "digest", "at", "grams").groupBy("shard").cogroup(known).applyInArrow(look_up, "home long, digest long, at int, p binary")

    def task(held: pa.Table, own: pa.Table) -> pa.Table:
        x, = held.to_pylist()
        if set(own["digest"].to_pylist()) != {x["digest"]}:
            raise RuntimeError("the two passes over the texts have seen different rows")
        p = np.frombuffer(b"".join(own.sort_by("at")["p"].to_pylist()), np.float32)
        cost = -np.log(p.astype(np.float64))
        joined, parts, at = _plain(x["texts"]).decode(), [], 0
        for size in x["size"]:
            parts.append(joined[at : at + size])
            at += size
        n = np.maximum(np.array(x["size"], np.int64) - ORDER + 1, 0)
        ends = np.cumsum(n)
        total = np.concatenate([[0.0], np.cumsum(cost[coded(parts)[1]])])
        values = [x["row"], x["doc"], x["lang"], total[ends] - total[ends - n], n]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds)], names=["row", "doc", "lang", "cost", "n"])

    by_part = packed.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(task, "row long, doc long, lang string, cost double, n long")
    return by_part.groupBy("row").agg(F.first("doc").alias("doc"), F.first("lang").alias("lang"), F.sum("cost").alias("cost"), F.sum("n").alias("n")).drop("row")


def costs(df: DataFrame, block: int | None = None) -> DataFrame:
    """df: doc, lang, text, fit. doc, lang, cost and n for each row, by the model of the fit rows."""
    block = block or BLOCK
    lists = cut(listed(df, block), "lists")
    entries = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = dealt(lists, max(1, -(-entries // SHARD)))
    asked = cut(counts(slices), "asked")
    scored = scores(asked.select("shard", "gram"), model(asked.where("c > 0").select("gram", "c")))
    return cut(sums(texts(df, block), slices, scored), "costs")


def trusted(labels: DataFrame) -> DataFrame:
    """doc: ids that all labels call good and none toxic."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"))
    return good.where("doc IS NOT NULL AND quality = 1 AND toxic = 0").select("doc")


def judged(df: DataFrame, key: str, text: str, lang: str, labels: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR) -> DataFrame:
    """doc, lang, perplexity, score, threshold (both by symbol, as perplexities), kept: a row for each row of df."""
    good = cut(trusted(labels).withColumn("held", F.pmod(F.xxhash64("doc"), F.lit(CALIBRATION)) == 0), "trusted")
    side = F.broadcast if good.count() <= BROADCAST_ROWS else (lambda x: x)
    slim = df.select(F.col(key).cast("long").alias("doc"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    marked = _settled(slim) if side is F.broadcast else slim
    marked = marked.join(side(good), "doc", "left").select("doc", "lang", "text", (~F.col("held")).alias("fit"))
    scored = costs(marked if side is F.broadcast else _settled(marked))

    held = scored.where("n > 0").join(side(good.where("held")), "doc", "left_semi").withColumn("own", F.col("lang"))
    usual = held.groupBy("own").agg((F.sum("cost") / F.sum("n")).alias("usual"))
    score = ((F.col("cost") + prior * F.col("usual")) / (F.col("n") + prior)).alias("score")
    held = held.drop("lang").join(usual.withColumnRenamed("own", "lang"), F.col("own").eqNullSafe(F.col("lang"))).select("own", "usual", score)
    held = cut(held, "held")
    by_lang = held.groupBy("own").agg(F.first("usual").alias("usual"), F.avg("score").alias("mean"), F.count("*").alias("of"), F.var_pop("score").alias("var"))
    pooled = by_lang.agg((F.sum(F.col("var") * F.col("of")) / F.sum("of")).alias("pooled"))  # one row
    sd = F.sqrt((F.col("of") * F.col("var") + POOL * F.col("pooled")) / (F.col("of") + POOL) * (1 + 1 / F.col("of")))
    at = F.col("mean") + NormalDist().inv_cdf(quantile) * sd
    by_lang = cut(by_lang.crossJoin(F.broadcast(pooled)).select("own", "usual", at.alias("threshold")), "thresholds")
    side = F.broadcast if by_lang.count() <= BROADCAST_ROWS else (lambda x: x)
    out = scored.join(side(by_lang), F.col("lang").eqNullSafe(F.col("own")), "left").select("doc", "lang", "cost", "n", score, "threshold")
    some = F.col("n") > 0
    return out.select("doc", "lang", F.when(some, F.exp(F.col("cost") / F.col("n"))).alias("perplexity"), F.when(some, F.exp("score")).alias("score"), F.exp("threshold").alias("threshold"), F.coalesce((F.col("score") <= F.col("threshold")) | ~some, F.lit(True)).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "labels"))
    return found.select(F.col("doc").alias("doc_id"), F.round("perplexity", 6).alias("perplexity"), F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "kept")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
