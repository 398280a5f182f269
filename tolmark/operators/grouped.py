"""Ordered folds over groups as one stream for each partition: no DataFrame for each group, so that many small groups cost little."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, key: str, order: list[str], schema: str, task: Callable[[Any, Iterator[tuple]], Iterable[tuple]], at_once: int = 4096) -> DataFrame:
    """task(key, rows) for each value of key, null included; rows are df's, in the given order (nulls first), and are read once.

    Groups are dealt over spark.sql.shuffle.partitions partitions, however small the table is.
    """
    made = T.StructType.fromDDL(schema)
    at = df.columns.index(key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(made)
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out = (row for value, group in groupby(rows, itemgetter(at)) for row in task(value, group))
        while held := list(islice(out, at_once)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), to)], schema=to)

    return df.repartition(parts, key).sortWithinPartitions(key, *order).mapInArrow(run, made)
