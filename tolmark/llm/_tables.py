"""Reading inputs, writing intermediate tables where every executor sees them, running Arrow passes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side with at most this many narrow rows (ids and counters, under 100 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


#: Rows of an Arrow batch, where the session has Spark's default: texts are long, and two workers share an executor's memory.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tolmark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


#: A group of more rows than this is hot, unless there may be more than BROADCAST_ROWS such groups.
HOT = 1_000


def attach(rows: DataFrame, groups: DataFrame, by: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of the group (by) that they belong to; rows of other groups go. groups: one row for each group, narrow, with
    its number of rows; both may be read twice. total: the number of rows. Hot groups are broadcast, of which there are at most
    BROADCAST_ROWS by the limit set here, and their rows stay where they are; the others are joined."""
    limit = max(HOT, total // BROADCAST_ROWS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    few = total <= BROADCAST_ROWS  # then the groups are few as well
    if few:
        return rows.join(F.broadcast(groups), by)
    cold = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(groups.where(F.col(size) <= limit), by)
    return rows.join(hot, by).unionByName(cold)


def arrow_type(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of numbers, none null, as views of its values."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[s:e] for s, e in pairwise((ends - ends[0]).tolist())]


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict[str, list]]], Iterator[tuple]], at_once: int = 4096, arrays: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow with a plain generator: rows() gets column batches as Python lists and yields output tuples. arrays: columns of lists of
    numbers, none null, whose lists come as NumPy arrays."""
    spark_schema = T.StructType.fromDDL(schema)
    names = spark_schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_type(spark_schema)

        def columns() -> Iterator[dict[str, list]]:
            for b in batches:
                for s in range(0, b.num_rows, 512):
                    part = b.slice(s, 512)
                    yield {n: lists(part.column(i)) if n in arrays else part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        held: list[tuple] = []
        for row in rows(columns()):
            held.append(row)
            if len(held) >= at_once:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), to)], schema=to)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), to)], schema=to)

    assert names
    return df.mapInArrow(run, spark_schema)
