"""Models and readers behind an interface, and how they run over tiles and crops.

A provider is any object with ``detect_regions``; the other readers are optional and fall back to ``read_region``. It is made once for each
Python worker by a factory, with retries. A tile that fails is skipped, a read that fails is empty: neither ends the job.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any, NamedTuple, Protocol, runtime_checkable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE, OVERLAP = 1024, 0.15
ATTEMPTS, DELAY = 3, 8.0


class Read(NamedTuple):
    text: str
    confidence: float


@runtime_checkable
class Reader(Protocol):
    def read_region(self, image: bytes) -> Read: ...


@runtime_checkable
class Detector(Protocol):
    def detect_regions(self, image: bytes) -> list[tuple[float, float, float, float, str, float]]: ...


class Stub:
    """Canned answers, for tests and dry runs."""

    def __init__(self, boxes: list | None = None, text: str = "1,2 +0,1 -0,1", confidence: float = 0.9) -> None:
        self.boxes, self.text, self.confidence = boxes or [], text, confidence

    def detect_regions(self, image: bytes) -> list:
        return list(self.boxes)

    def read_region(self, image: bytes) -> Read:
        return Read(self.text, self.confidence)


def tiling(tile: int | None = None, overlap: float | None = None, env: Mapping[str, str] | None = None) -> tuple[int, float]:
    """The argument, else a well-formed environment variable, else the default."""
    env = os.environ if env is None else env

    def chosen(given: Any, name: str, kind: Callable, fallback: Any) -> Any:
        if given is not None:
            return given
        try:
            return kind(env[name])
        except (KeyError, ValueError):
            return fallback

    return chosen(tile, "DETECT_TILE", int, TILE), chosen(overlap, "DETECT_OVERLAP", float, OVERLAP)


def made(factory: Callable[[], Any], attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What the factory makes, tried a few times with a pause between; the last error if none works."""
    for k in range(attempts):
        try:
            return factory()
        except Exception as e:  # noqa: BLE001  any failure of a model to load is retried
            last = e
            if k + 1 < attempts:
                sleep(delay)
    raise RuntimeError(f"provider failed to load after {attempts} attempts: {last}") from last


def with_fallback(first: Callable[[], Any], second: Callable[[], Any], **retry: Any) -> tuple[Any, str | None]:
    """The first provider, or the second and why."""
    try:
        return made(first, **retry), None
    except RuntimeError as e:
        return second(), str(e)


def capability(provider: Any, name: str) -> Callable[[bytes], Read]:
    """The named reader if the provider has it, else its general one."""
    return getattr(provider, name, None) or provider.read_region


def require_detector(provider: Any, reason: str | None = None) -> None:
    if not isinstance(provider, Detector):
        raise RuntimeError("a provider with detect_regions is needed" + (f" ({reason})" if reason else ""))


def safe_read(reader: Callable[[bytes], Read], image: bytes) -> Read:
    try:
        found = reader(image)
        return Read(found.text, found.confidence if (found.text or "").strip() else 0.0)
    except Exception:  # noqa: BLE001  a read never ends the job
        return Read("", 0.0)


_providers: dict[str, Any] = {}


def _name(factory: Callable[[], Any]) -> str:
    """A factory by its contents: tasks unpickle copies of it, whose addresses say nothing."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _once(name: str, factory: Callable[[], Any]) -> Any:
    if name not in _providers:
        _providers[name] = made(factory)
    return _providers[name]


def detect_tiles(tiles: DataFrame, factory: Callable[[], Any]) -> DataFrame:
    """tiles: page, tile, x0, y0, image. page, tile, ord, box in page coordinates, kind, conf; tiles that fail give nothing."""
    name = _name(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = _once(name, factory)
        require_detector(provider)
        for b in batches:
            rows = []
            for page, tile, x, y, image in b[["page", "tile", "x0", "y0", "image"]].itertuples(index=False):
                try:
                    found = provider.detect_regions(image)
                except Exception:  # noqa: BLE001  a tile never ends the job
                    continue
                rows += [(page, tile, k, int(d[0] + x), int(d[1] + y), int(d[2] + x), int(d[3] + y), d[4], float(d[5])) for k, d in enumerate(found)]
            yield pd.DataFrame(rows, columns=["page", "tile", "ord", "x0", "y0", "x1", "y1", "kind", "conf"])

    return tiles.mapInPandas(run, "page long, tile long, ord long, x0 int, y0 int, x1 int, y1 int, kind string, conf double")


def reader_udf(factory: Callable[[], Any], name: str = "read_region") -> Callable:
    """An iterator pandas UDF from an image to struct<text, confidence>; the model is loaded once for each worker."""
    held = _name(factory)

    @F.pandas_udf("text string, confidence double")
    def read(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = capability(_once(held, factory), name)
        for s in images:
            yield pd.DataFrame([safe_read(reader, x) for x in s], columns=["text", "confidence"])

    return read


def whole(image: bytes, box: tuple[int, int, int, int]) -> bytes:
    """The crop of a provider that cuts for itself."""
    return image


def read_boxes(
    boxes: DataFrame,
    factory: Callable[[], Any],
    crop: Callable[[bytes, tuple[int, int, int, int]], bytes] = whole,
    turned: Callable[[bytes, int], bytes] | None = None,
) -> DataFrame:
    """boxes: page, ord, kind, x0, y0, x1, y1, image. The same without the image, with text and confidence; geometric frames by their own reader.

    With turned (a crop and degrees to a crop), upright boxes (see order.vertical) but for such frames are read turned to the right
    and to the left, as candidates 0 and 1; other boxes have candidate 0 alone.
    """
    name = _name(factory)

    def ways(provider: Any, kind: str | None, box: tuple[int, int, int, int]) -> tuple[str, tuple[int, ...]]:
        if kind == "gdt" and hasattr(provider, "read_region_gdt"):
            return "read_region_gdt", (0,)
        upright = turned is not None and None not in box and (box[3] - box[1]) * 10 > (box[2] - box[0]) * 13
        return "read_region", (-90, 90) if upright else (0,)

    def one(reader: Callable[[bytes], Read], image: bytes, box: tuple[int, int, int, int], degrees: int) -> Read:
        try:
            part = crop(image, box)
            return safe_read(reader, turned(part, degrees) if degrees else part)
        except Exception:  # noqa: BLE001  as with a read that fails
            return Read("", 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = _once(name, factory)
        for b in batches:
            at, rows = [], []
            for k, (image, kind, *sides) in enumerate(b[["image", "kind", "x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)):
                how, turns = ways(provider, kind, tuple(sides))
                at += [k] * len(turns)
                rows += [(c, one(capability(provider, how), image, tuple(sides), d)) for c, d in enumerate(turns)]
            yield b.drop(columns="image").iloc[at].assign(text=[r.text for _, r in rows], confidence=[float(r.confidence) for _, r in rows], candidate=[c for c, _ in rows])

    own = boxes.select("page", "ord", "kind", "x0", "y0", "x1", "y1", "image")
    read = own.mapInPandas(run, "page long, ord long, kind string, x0 int, y0 int, x1 int, y1 int, text string, confidence double, candidate int")
    return read if turned is not None else read.drop("candidate")
