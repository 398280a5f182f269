"""Line dedup: lines that many documents share go from all documents but one.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the largest doc_id
that holds them.

Only hashes travel: a row (128-bit key hash, doc_id, positions) for each key of a document. The rows are
range-partitioned by (hash, doc_id descending) and sorted so within each partition, so that the rows of a very
frequent key lie in as many partitions as they need. A stream over each partition sees the first occurrence (the largest
doc_id) of a key, then the others, and holds fewer than ``min_docs`` of them at a time. A key's rows may go on in the
next partition: rows of a partition's first key, and of its last key while it has too few documents, wait for the
totals of such keys, of which there are two for each partition at most. What comes back to a document is a compressed
bitmap of the lines to keep; a document without a bitmap keeps all.

Defined results: null text counts as empty, an empty text is one empty line. Rows without doc_id hold no key and keep
all lines. Rows that repeat a doc_id count as one document; each is judged by its own text. An empty table gives an
empty result. Columns other than key and text are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tolmark.llm._tables import arrow_type, cut, map_rows, table

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS, MIN_DOCS = 40, 5

FINAL, WAITING, TOTAL = 0, 1, 2
_ROWS = "kind int, h1 long, h2 long, doc long, print long, lines array<int>, n long"


def _key(line: bytes, min_chars: int) -> bytes | None:
    line = line.strip(SPACE)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return line.lower()  # of bytes: A-Z only


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: doc, print, text. A row for each document and key."""

    def rows(batches: Iterator[dict]) -> Iterator[tuple]:
        for b in batches:
            for doc, mark, text in zip(b["doc"], b["print"], b["text"]):
                found: dict[int, list[int]] = {}
                for at, line in enumerate(bytes(text).split(b"\n")):
                    if (key := _key(line, min_chars)) is not None:
                        found.setdefault(xxhash.xxh3_128_intdigest(key), []).append(at)
                for h, lines in found.items():
                    yield (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc, mark, lines

    return map_rows(docs, "h1 long, h2 long, doc long, print long, lines array<int>", rows)


def _judged(hashes: DataFrame, min_docs: int) -> DataFrame:
    """The stream over each sorted partition."""

    def rows(batches: Iterator[dict]) -> Iterator[tuple]:
        key, first, held, n, last, most = None, True, [], 0, None, None

        def ended() -> Iterator[tuple]:
            """The first key may have begun in an earlier partition."""
            if key is not None and first:
                yield TOTAL, *key, most, None, None, n

        for b in batches:
            for h1, h2, doc, mark, lines in zip(b["h1"], b["h2"], b["doc"], b["print"], b["lines"]):
                if (h1, h2) != key:
                    yield from ended()
                    first = key is None
                    key, held, n, last, most = (h1, h2), [], 0, None, doc
                n += doc != last
                last = doc
                if first:
                    yield WAITING, h1, h2, doc, mark, lines, None
                elif n < min_docs:
                    held.append((doc, mark, lines))
                else:
                    for d, m, x in held:
                        if d != most:
                            yield FINAL, h1, h2, d, m, x, None
                    held = []
                    yield FINAL, h1, h2, doc, mark, lines, None
        if key is not None:  # the last key may go on in a later partition
            yield TOTAL, *key, most, None, None, n
            for d, m, x in held:
                yield WAITING, *key, d, m, x, None

    return map_rows(hashes, _ROWS, rows)


def pack(dropped: list[int]) -> bytes:
    """A keep bitmap up to the last dropped line; the lines after it are kept."""
    bits = np.ones(max(dropped) + 1, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes() + bytes([len(bits) % 8]), 1)


def unpack(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8), bitorder="little")
    return bits[: len(bits) - (-raw[-1] % 8)].astype(bool)


def _slim(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("print"), F.encode(body, "utf-8").alias("text"))


def keep_bitmaps(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, print (xxhash64 of the text), bitmap: a row for each document (and text) that loses lines."""
    hashes = cut(_hashes(_slim(df, key, text).where("doc IS NOT NULL"), min_chars), "line-hashes")
    ordered = hashes.repartitionByRange("h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "print")
    judged = cut(_judged(ordered, min_docs), "line-judged")
    totals = judged.where(F.col("kind") == TOTAL).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("most")).where(F.col("docs") >= min_docs)
    late = judged.where(F.col("kind") == WAITING).join(F.broadcast(totals), ["h1", "h2"]).where("doc <> most")  # two totals for each partition at most
    dropped = judged.where(F.col("kind") == FINAL).select("doc", "print", "lines").unionByName(late.select("doc", "print", "lines"))

    def rows(batches: Iterator[dict]) -> Iterator[tuple]:
        for b in batches:
            for doc, mark, lines in zip(b["doc"], b["print"], b["lines"]):
                yield doc, mark, pack(lines)

    by_doc = dropped.groupBy("doc", "print").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    return map_rows(by_doc, "doc long, print long, bitmap binary", rows)


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Number of lines, number dropped, the text that stays."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = unpack(bitmap)
    stay = [x for x, k in zip(lines, keep) if k] + lines[len(keep) :]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def apply_bitmaps(df: DataFrame, key: str, text: str, bitmaps: DataFrame, made: Callable[[int, int, bytes], tuple], fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """The columns keep of df and those that made() gives for (lines, dropped, text that stays)."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(F.struct(*(F.col(c) for c in keep)).alias("row"), F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("print"), F.encode(body, "utf-8").alias("text"))
    both = slim.join(bitmaps, ["doc", "print"], "left").select("row", "text", "bitmap")
    schema = T.StructType([*(f for f in both.schema["row"].dataType.fields), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_type(schema)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                rows = [made(*kept_lines(t, m)) for t, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.column(0).flatten(), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(to)[len(keep) :]))], schema=to)

    return both.mapInArrow(run, schema)


def dedup_lines(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """df with the lines that go taken out of its text; other columns as they were."""
    bitmaps = keep_bitmaps(df, key, text, min_chars, min_docs)
    others = [c for c in df.columns if c != text]
    out = apply_bitmaps(df, key, text, bitmaps, lambda _, __, body: (body.decode("utf-8", "replace"),), [T.StructField(text, T.StringType())], others)
    return out.select(df.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return apply_bitmaps(docs, "doc_id", "text", keep_bitmaps(docs, "doc_id", "text"), lambda n, gone, body: (n, gone, hashlib.sha256(body).hexdigest()), fields, ["doc_id"])


SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS most FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), judged AS (
  SELECT doc_id, pos, line, most IS NOT NULL AND most <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": SQL}
