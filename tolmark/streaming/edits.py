"""Review sessions as logs of edits: add, delete, move, accept, undo, redo, folded in order for each session."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tolmark.operators.grouped import fold

# Event types of the base table and the edits that they stand for.
EDITS = {"signup": "add", "error": "delete", "click": "move", "purchase": "accept", "view": "undo"}
RESULT = "session long, id long, pos int, x int, y int, reviewed boolean"
BAND = 60


class Session:
    """Rows by id, and the edits done and undone. A new edit forgets what was undone."""

    def __init__(self) -> None:
        self.rows: dict[int, dict[str, Any]] = {}
        self.done: list[tuple] = []
        self.undone: list[tuple] = []

    def apply(self, op: str, at: int, x: int, y: int) -> None:
        if op in ("undo", "redo"):
            source, to = (self.done, self.undone) if op == "undo" else (self.undone, self.done)
            if source:
                edit = source.pop()
                at, before, after = edit
                self._put(at, before if op == "undo" else after)
                to.append(edit)
            return
        before = self.rows.get(at)
        if op == "add":
            after = before or {"x": x, "y": y, "reviewed": False}
        elif op == "delete":
            after = None
        elif before is None:
            after = None
        else:
            after = {**before, "x": x, "y": y} if op == "move" else {**before, "reviewed": True}
        self.done.append((at, before, after))
        self.undone.clear()
        self._put(at, after)

    def _put(self, at: int, row: dict | None) -> None:
        if row is None:
            self.rows.pop(at, None)
        else:
            self.rows[at] = row

    def numbered(self) -> list[tuple]:
        """id, pos, x, y, reviewed in reading order; bands round half up."""
        order = sorted(self.rows.items(), key=lambda r: (math.floor(r[1]["y"] / BAND + 0.5), r[1]["x"], r[0]))
        return [(at, k + 1, r["x"], r["y"], r["reviewed"]) for k, (at, r) in enumerate(order)]


def replayed(edits: Iterable[tuple]) -> list[tuple]:
    s = Session()
    for op, at, x, y in edits:
        s.apply(op, at, x, y)
    return s.numbered()


def _named(edits: DataFrame) -> DataFrame:
    op = F.col("op")
    for event, edit in EDITS.items():
        op = F.when(F.col("op") == event, edit).otherwise(op)
    return edits.withColumn("op", op)


def replay(edits: DataFrame) -> DataFrame:
    """edits: session, seq, op, id, x, y. The rows that each session ends with."""

    def task(session: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in replayed(r[2:] for r in rows):
            yield session, *row

    return fold(_named(edits).select("session", "seq", "op", "id", "x", "y"), "session", ["seq"], RESULT, task)


def stream(edits: DataFrame) -> DataFrame:
    """The same over a stream: after each batch, the present rows of every session that it touched. Edits come in order within a session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = pickle.loads(state.get[0]) if state.exists else Session()
        log = pd.concat(list(batches)).sort_values("seq")
        for op, at, x, y in log[["op", "id", "x", "y"]].itertuples(index=False, name=None):
            session.apply(op, at, x, y)
        state.update((pickle.dumps(session),))
        yield pd.DataFrame([(key[0], *r) for r in session.numbered()], columns=["session", "id", "pos", "x", "y", "reviewed"])

    return _named(edits).groupBy("session").applyInPandasWithState(step, RESULT, "held binary", "update", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame, key: str, at: str, what: str) -> DataFrame:
    """The last progress event of each key; works on tables and, in update mode, on streams."""
    return events.groupBy(key).agg(F.max_by(what, at).alias("latest"), F.count("*").alias("events"))
