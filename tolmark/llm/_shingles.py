"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a run of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased. A word's hash sums, over its bytes, a scrambled product of a random
number for the byte and one for its place in the word (there is no base whose powers repeat or die out modulo 2^64, so long words
of few letters collide no more than others); a shingle's hash mixes those of its words in order. All of it is array arithmetic on
the texts' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_random = np.random.default_rng(20_240_229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _random.integers(1, 1 << 63, 64, dtype=_U) * _U(2) + _U(1)
#: Texts are taken together up to about so many bytes.
AT_ONCE = 1 << 20

_places = np.empty(0, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _place(n: int) -> np.ndarray:
    """An odd random number for each place in a word of n bytes."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(max(n, 2 * len(_places)), dtype=_U) + _U(0x9E3779B97F4A7C15)) | _U(1)
    return _places


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after the other in data, and of each text where its words end. ends: where texts end."""
    space = _IS_SPACE[data]
    inner = ~space
    begins = inner.copy()
    begins[1:] &= space[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inner[first]
    stops = inner.copy()
    stops[:-1] &= space[1:]
    last = ends[ends > 0] - 1
    stops[last] = inner[last]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(begin):
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    size = stop - begin
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        term = _BYTE[data[inner]] * _place(int(size.max()))[place]
        term ^= term >> _U(29)
        found = mix(np.add.reduceat(term, first))
    return found, np.searchsorted(begin, ends)


def shingles(word: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles of n words of one text, sorted; with fewer words, the whole sequence as one."""
    n = min(n, len(word))
    if not n:
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        out = np.full(len(word) - n + 1, n, _U)
        for k in range(n):
            out = mix(out * _PLACE[0] + word[k : len(word) - n + 1 + k] * _PLACE[1 + k % 63])
    return np.unique(out)


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a string column; of null, the empty set."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE)) - 1)
        to = min(to, len(column))
        found, ends = words(data[bounds[at] : bounds[to]], bounds[at + 1 : to + 1] - bounds[at])
        begin = 0
        for k, end in enumerate(ends.tolist()):
            yield shingles(found[begin:end], n) if not missing[at + k] else np.empty(0, _U)
            begin = end
        at = to
