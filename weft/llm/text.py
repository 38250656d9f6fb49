"""Vectorised views of a batch of texts: words, shingles and their fingerprints.

Everything works on the UTF-8 bytes of an Arrow string column, a bounded run of
documents at a time, so no Python object is made for a word. A word is a maximal
run of bytes other than space and TAB..CR; since UTF-8 never uses those bytes
inside a character, byte runs and character runs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; one longer document makes a run of its own.
RUN_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_draw = np.random.default_rng(20240917)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _draw.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = tuple(np.uint64(x) for x in _draw.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


@dataclass
class Run:
    """Consecutive documents of a batch.

    data: their bytes; begin: each document's first byte in data, and the end;
    first: the index in the batch of the first one; start, end: bounds of each
    word in data; doc: the document of each word, counted from 0 in this run;
    words: the first word of each document, and the end.
    """

    first: int
    data: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray

    @property
    def size(self) -> int:
        return len(self.begin) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.size), np.diff(self.words))

    def word_hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        total = int(length.sum())
        place = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        at = place + np.repeat(self.start, length)
        weight = _PLACE[place & 4095]
        if int(length.max()) > 4096:  # of a longer word, each further 4096 bytes have weights of their own
            far = np.flatnonzero(place >> 12)
            weight[far] = mix(weight[far] + (place[far] >> 12).astype(np.uint64)) | np.uint64(1)
        parts = _BYTE[self.data[at]] * weight
        sums = np.add.reduceat(parts, np.cumsum(length) - length)
        return mix(sums + length.astype(np.uint64) * _STEP[3])

    def inside(self, k: int) -> np.ndarray:
        """For each start of k consecutive words of the run, whether they are of one document."""
        n = max(len(self.start) - k + 1, 0)
        doc = self.doc
        return doc[:n] == doc[k - 1 : k - 1 + n]


def sequences(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A fingerprint of every k consecutive values; which: one of two independent kinds."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = _STEP[which]
    level, width, out, done = hashes if which == 0 else mix(hashes + step), 1, None, 0
    power, left = step, k
    while left:
        if left & 1:
            piece = level[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += width
        left >>= 1
        if left:
            level = level[: len(level) - width] * power + level[width:]
            width *= 2
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return mix(out)


def sliding(values: np.ndarray, k: int, least: bool = True) -> np.ndarray:
    """The least (or greatest) of every k consecutive values."""
    pick = np.minimum if least else np.maximum
    n = len(values) - k + 1
    if n <= 0:
        return values[:0]
    level, width = values, 1
    while width * 2 <= k:
        level = pick(level[: len(level) - width], level[width:])
        width *= 2
    return pick(level[:n], level[k - width : k - width + n])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's bounds; a null row has none."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def cuts(bounds: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of rows with at most so many bytes, or of one row."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def runs(column: pa.Array, lower: bool = False, most: int = RUN_BYTES) -> Iterator[Run]:
    """The words of a text column. lower: A-Z become a-z first."""
    data, bounds = bytes_of(column)
    for at, to in cuts(bounds, most):
        own = data[bounds[at] : bounds[to]]
        if lower:
            own = _LOWER[own]
        begin = (bounds[at : to + 1] - bounds[at]).astype(np.int64)
        gap = np.ones(len(own) + 1, bool)
        gap[:-1] = _SEPARATOR[own]
        before = np.ones(len(own) + 1, bool)
        before[1:] = gap[:-1]
        edge = np.zeros(len(own) + 1, bool)
        edge[begin] = True  # a document's first byte starts a word, whatever stands before it
        start = np.flatnonzero(~gap & (before | edge))
        end = np.flatnonzero(~before & (gap | edge))
        yield Run(at, own, begin, start, end, np.searchsorted(start, begin))


def per_doc(run: Run, flat: np.ndarray) -> np.ndarray:
    """Sums of one value a word over each document."""
    total = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(flat, out=total[1:])
    return total[run.words[1:]] - total[run.words[:-1]]
