"""Merging of boxes until nothing changes. The result of the stack merge depends on the order in which boxes are met, so a page is
merged in one place, a group at a time. Boxes with a null side are left out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolmark.operators.grouped import fold

_WHOLE = "x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL"


def _near(a: tuple, b: tuple, x_tol: int, y_gap: int) -> bool:
    return a[0] <= b[2] + x_tol and b[0] <= a[2] + x_tol and max(a[1] - b[3], b[1] - a[3]) <= y_gap


def _joined(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def absorb(boxes: list[tuple[tuple, int, int]], x_tol: int, y_gap: int, cap: float | None) -> list[tuple[tuple, int, int]]:
    """(box, confidence, ord) rows, each absorbing later ones that are near, pass after pass."""
    while True:
        left, out = list(boxes), []
        while left:
            (box, conf, at), rest = left[0], []
            for other in left[1:]:
                both = _joined(box, other[0])
                if _near(box, other[0], x_tol, y_gap) and (cap is None or both[3] - both[1] <= cap):
                    box, conf = both, max(conf, other[1])
                else:
                    rest.append(other)
            out.append((box, conf, at))
            left = rest
        if len(out) == len(boxes):
            return out
        boxes = out


def stack_merge(dets: DataFrame, x_tol: int = 20, y_gap: int = 20, lines: int = 2) -> DataFrame:
    """page, kind, ord (of the first member), box, conf. A merged box is no taller than `lines` median rows of its page and their gaps."""

    def task(page: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        boxes = list(rows)
        cap = lines * median(r[6] - r[4] for r in boxes) + (lines - 1) * y_gap
        boxes.sort(key=lambda r: (r[1] is not None, r[1]))  # by kind, and by ord as before
        for kind, part in groupby(boxes, itemgetter(1)):
            for box, conf, at in absorb([((r[3], r[4], r[5], r[6]), r[7], r[2]) for r in part], x_tol, y_gap, cap):
                yield page, kind, at, *box, conf

    rows = dets.where(_WHOLE).select("page", "kind", "ord", "x0", "y0", "x1", "y1", F.coalesce("conf", F.lit(0)).alias("conf"))
    return fold(rows, "page", ["ord"], f"page long, kind string, ord long, x0 int, y0 int, x1 int, y1 int, conf {rows.schema['conf'].dataType.simpleString()}", task)


def note_cluster(dets: DataFrame, x_tol: int = 30, y_gap: int = 40) -> DataFrame:
    """page and the largest cluster of its notes (first of equals)."""

    def task(page: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        clusters = absorb([(r[2:6], 0, r[1]) for r in rows], x_tol, y_gap, None)
        best = max(clusters, key=lambda r: (r[0][2] - r[0][0]) * (r[0][3] - r[0][1]))
        yield page, *best[0]

    notes = dets.where(F.col("kind") == "note").where(_WHOLE).select("page", "ord", "x0", "y0", "x1", "y1")
    return fold(notes, "page", ["ord"], "page long, x0 int, y0 int, x1 int, y1 int", task)
