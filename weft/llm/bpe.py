"""Byte-level BPE by ranks: encoding with a two-tier lookup, and decoding.

A text is split into pre-tokens. The first tier is a minimal perfect hash over the
vocabulary: one displacement table and one slot a token, so a pre-token that is itself a
token is found by two table reads and a comparison of its bytes. The second tier merges
the bytes of the others: parts are linked left and right, and a heap gives the pair of
least rank, leftmost first. Each distinct pre-token of a slice is looked up once; a
bounded memory of results is kept by the worker between slices.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import frames, text

#: Rows that are encoded together, and pre-tokens that a worker remembers.
SLICE, REMEMBERED = 512, 200_000


def fingerprints(keys: list[bytes]) -> np.ndarray:
    """A 64-bit value for each of some byte strings, none of them empty."""
    data = np.frombuffer(b"".join(keys), np.uint8)
    end = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    start = np.append(0, end[:-1])
    return text.Run(0, data, np.array([0, len(data)]), start, end, np.array([0, len(keys)])).word_hashes()


class MinimalPerfectHash:
    """Sends each of n distinct byte strings to its own slot of n.

    Keys fall into buckets; the largest bucket first, a bucket takes the least
    displacement that sends its keys to free slots. Buckets of one key come last and hold
    the number of a free slot itself (as a negative displacement).
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 2)
        self.shift = np.zeros(self.buckets, np.int64)
        prints = fingerprints(keys)
        bucket = (prints % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        count = np.diff(bounds)
        taken = np.zeros(self.size, bool)
        tries = np.arange(1, 65)[:, None]
        for b in np.argsort(-count, kind="stable"):
            if count[b] < 2:
                break
            own, base = prints[order[bounds[b] : bounds[b + 1]]][None, :], 0
            while True:
                slot = np.sort(self._slots(own, tries + base), axis=1)
                fits = np.flatnonzero(~taken[slot].any(axis=1) & (slot[:, 1:] != slot[:, :-1]).all(axis=1))
                if len(fits):
                    break
                base += len(tries)
            taken[slot[fits[0]]] = True
            self.shift[b] = base + 1 + fits[0]
        lone = np.flatnonzero(count == 1)
        self.shift[lone] = -1 - np.flatnonzero(~taken)[: len(lone)]

    def _slots(self, prints: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (text.mix(prints + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        prints = fingerprints(keys)
        shift = self.shift[(prints % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(prints, np.abs(shift)))


class Splitter:
    """findall() of a split pattern that names \\p{L}, \\p{N} and \\s.

    The regex module knows these classes but is slower than re; where all characters of a
    text lie below U+0250, re gets the classes spelled out.
    """

    def __init__(self, pattern: str):
        low = [chr(c) for c in range(0x250)]
        named = {kind: "".join(map(re.escape, (c for c in low if unicodedata.category(c)[0] == kind))) for kind in "LN"}
        space = "".join(re.escape(c) for c in low if c.isspace() and not "\x1c" <= c <= "\x1f")
        spelled = pattern.replace(r"\p{L}", "\0L").replace(r"\p{N}", "\0N")
        outside = r"[^\s" + "\0L\0N]+"
        spelled = spelled.replace(outside, f"[^{space}{named['L']}{named['N']}]+").replace("\0L", f"[{named['L']}]").replace("\0N", f"[{named['N']}]")
        self._low = re.compile(spelled.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        self._any = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._high = re.compile("[^\0-ɏ]")

    def __call__(self, line: str) -> list[str]:
        return (self._any if self._high.search(line) else self._low).findall(line)


class Decoder:
    """The bytes of each id of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self._bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self._length = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self._start = np.cumsum(self._length) - self._length

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids after each other, and each id's bounds among them; an unknown id has none."""
        ids = np.where((ids >= 0) & (ids < len(self._length)), ids, 0) if len(ids) and (ids.min() < 0 or ids.max() >= len(self._length)) else ids
        return _gather(self._bytes, self._start, self._length, ids)

class Remembering:
    """Encodes the distinct pre-tokens of a slice once each, and remembers those met lately."""

    def __init__(self, pattern: str):
        self.split = Splitter(pattern)
        self._older: dict[str, tuple[int, ...]] = {}
        self._newer: dict[str, tuple[int, ...]] = {}

    def _learn(self, new: list[str]) -> None:
        """Puts the ids of each of new into _newer."""
        raise NotImplementedError

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and each text's bounds among them."""
        if len(self._newer) > REMEMBERED:  # half of what is kept goes, that which was not met lately
            self._older, self._newer = self._newer, {}
        words = [self.split(t) if t else [] for t in texts]
        distinct: dict[str, int] = {}
        codes = np.fromiter((distinct.setdefault(w, len(distinct)) for own in words for w in own), np.int64, sum(map(len, words)))
        newer, older = self._newer, self._older
        newer.update((w, older[w]) for w in distinct if w not in newer and w in older)
        if new := [w for w in distinct if w not in newer]:
            self._learn(new)
        found = list(map(newer.__getitem__, distinct))
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(length.sum()))
        ids, bounds = _gather(flat, np.cumsum(length) - length, length, codes)
        return ids, bounds[np.append(0, np.cumsum(list(map(len, words)), dtype=np.int64))]


class Encoder(Remembering):
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        super().__init__(pattern)
        tokens = list(self.ranks)
        self.hash = MinimalPerfectHash(tokens)
        self.token_at: list[bytes] = [b""] * len(tokens)
        for slot, token in zip(self.hash.slots(tokens).tolist(), tokens, strict=True):
            self.token_at[slot] = token
        self._single = [self.ranks[bytes([b])] for b in range(256)]
        self._pair: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None:
                    self._pair[a << 32 | b] = rank
        self._first = np.array([self._pair.get(a << 32 | b, -1) for a in self._single for b in self._single])

    def merge(self, piece: bytes, first: list[int]) -> tuple[int, ...]:
        """The ids of one pre-token that is no token itself. first: the rank of each pair of bytes, or -1."""
        pair, pop, push, low = self._pair.get, heapq.heappop, heapq.heappush, 0xFFFFFFFF
        n = len(piece)
        part = [self._single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << 32 | at for at, rank in enumerate(first) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            least = pop(heap)
            at, rank = least & low, least >> 32
            right = after[at]
            if right == n or part[at] < 0 or pair(part[at] << 32 | part[right]) != rank:
                continue  # one of the two has been merged since
            part[at], part[right] = rank, -1
            after[at] = to = after[right]
            if to < n:
                before[to] = at
                if (found := pair(rank << 32 | part[to])) is not None:
                    push(heap, found << 32 | at)
            left = before[at]
            if left >= 0 and (found := pair(part[left] << 32 | rank)) is not None:
                push(heap, found << 32 | left)
        return tuple(x for x in part if x >= 0)

    def _learn(self, new: list[str]) -> None:
        pieces = [x.encode() for x in new]
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        first = np.append(self._first[data[:-1] << 8 | data[1:]], -1).tolist()
        at = 0
        for word, piece, slot in zip(new, pieces, self.hash.slots(pieces).tolist(), strict=True):
            token = self.token_at[slot]
            to = at + len(piece)
            self._newer[word] = (self.ranks[token],) if token == piece else self.merge(piece, first[at : to - 1])
            at = to


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start[w] : start[w] + length[w]] for each w of which, after each other, and the bounds."""
    own = length[which]
    bounds = np.zeros(len(which) + 1, np.int64)
    np.cumsum(own, out=bounds[1:])
    return flat[np.arange(bounds[-1]) + np.repeat(start[which] - bounds[:-1], own)], bounds


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process."""
    return Encoder(path, pattern)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every row of docs (doc_id, text; others are ignored).

    path: a rank file that every executor has; pattern: how texts are split. A null or
    empty text has no ids; repeated rows are encoded each. No special tokens.
    """

    def each(batch):
        own = encoder(path, pattern)
        texts = batch.column(2).to_pylist()
        for at in range(0, len(texts), SLICE):
            ids, bounds = own.encode(texts[at : at + SLICE])
            yield pa.record_batch([batch.column(1)[at : at + SLICE], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return frames.arrow_map(frames.keyed(docs), each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with the bytes that the ids stand for, as binary ``decoded``; null ids have none."""

    def each(batch):
        own = decoder(path)
        column = batch.column(1)
        for at in range(0, batch.num_rows, SLICE):
            part = column[at : at + SLICE]
            ids, sizes = part.flatten().to_numpy(zero_copy_only=False), np.array([len(x) if x.is_valid else 0 for x in part])
            data, bounds = own.decode(ids)
            cut = bounds[np.append(0, np.cumsum(sizes, dtype=np.int64))]
            out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.record_batch([batch.column(0)[at : at + SLICE], part, out], ["doc_id", "ids", "decoded"])

    return frames.arrow_map(encoded.select("doc_id", "ids"), each, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    back = decode(encode(docs, path, pattern), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


assert sys.byteorder == "little"
