"""Document fingerprints: improbable features in chained Bloom filters.

Every window of ``SPAN`` bytes of a text has a level, the number of equal pairs among its
bytes (its collision entropy, in integers). How often each level occurs in the whole
corpus gives its rarity, and windows are ranked by the rarity of their level. A window is
a feature if no window of some run of ``REACH`` neighbours ranks before it (equal ranks:
by a fingerprint of its bytes), so that the choice depends on nearby bytes alone and
survives edits elsewhere. Features go, in order, into Bloom filters of ``BITS`` bits; one
that holds ``FULL`` features is followed by another.

Two fingerprints are compared filter by filter: of the shorter chain each filter takes its
best match in the other; common bits count beyond those that chance might give (its mean
and two deviations), as a share of the most there could be, and filters weigh by their bits.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import frames, text

SPAN, REACH, BITS, FULL, MARKS = 32, 32, 1024, 96, 4
#: Windows with more equal pairs than this hold little but one or two characters; they rank last.
DULL = SPAN * (SPAN - 1) // 8
LEVELS = SPAN * (SPAN - 1) // 2 + 1


def levels(data: np.ndarray) -> np.ndarray:
    """The number of equal pairs in each window of SPAN bytes, by what leaves and what enters it."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    after, before = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, SPAN):
        same = (data[:-d] == data[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    first = sum(int((data[: SPAN - d] == data[d:SPAN]).sum()) for d in range(1, SPAN))
    change = before[SPAN:].astype(np.int64) - after[: n - 1]
    return first + np.append(0, np.cumsum(change))


def _inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Of n window starts, those whose window lies in one text."""
    last = np.zeros(n + SPAN, np.int64)
    size = np.diff(bounds)
    ok = size >= SPAN
    np.add.at(last, bounds[:-1][ok], 1)
    np.add.at(last, bounds[1:][ok] - SPAN + 1, -1)
    return np.cumsum(last)[:n] > 0


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each level, rarest first, counted over all windows of all documents; LEVELS numbers."""

    def each(batch):
        total = np.zeros(LEVELS, np.int64)
        data, bounds = text.bytes_of(batch.column(2))
        for at, to in text.cuts(bounds):
            own = bounds[at : to + 1] - bounds[at]
            level = levels(data[bounds[at] : bounds[to]])
            total += np.bincount(level[_inside(own, len(level))], minlength=LEVELS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["level", "n"])

    counted = frames.arrow_map(frames.keyed(docs), each, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(LEVELS, np.int64)
    for row in counted:
        total[row["level"]] = row["n"]
    order = np.lexsort((np.arange(LEVELS), np.where(total == 0, np.iinfo(np.int64).max, total), np.arange(LEVELS) > DULL))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def filters(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The chain of each text: filters by bytes, one row a filter. A text under SPAN bytes is one feature; an empty one has no filter."""
    docs = len(bounds) - 1
    level = levels(data)
    n = len(level)
    doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n:
        inside = _inside(bounds, n)
        prints = text.sequences(text.mix(text._BYTE[data]), SPAN)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        key = np.where(inside, (rank[level].astype(np.uint64) << np.uint64(48)) | (prints >> np.uint64(16)), top)
        padded = np.concatenate([np.full(REACH - 1, top), key, np.full(REACH - 1, top)])
        least = text.sliding(padded, REACH)
        # A run of neighbours counts only if it lies in one text, or covers a short text whole.
        begin = np.repeat(bounds[:-1], np.diff(bounds))[:n]
        stop = np.repeat(bounds[1:], np.diff(bounds))[:n] - SPAN
        place = np.arange(n)
        chosen = np.zeros(n, bool)
        full = inside & (stop - begin + 1 >= REACH)
        # least[i] is over key[i - REACH + 1 .. i], so a run that starts at s is least[s + REACH - 1].
        held = np.where(full, least[place + REACH - 1], 0)
        held[~full | (place > stop - REACH + 1)] = 0
        best = text.sliding(np.concatenate([np.zeros(REACH - 1, np.uint64), held]), REACH, least=False)
        chosen[full] = best[full] == key[full]
        short = inside & (stop - begin + 1 < REACH)
        if short.any():
            at = np.flatnonzero(short)
            order = np.lexsort((at, key[at], begin[at]))
            firsts = at[order][np.append(True, begin[at[order]][1:] != begin[at[order]][:-1])]
            chosen[firsts] = True
        at = np.flatnonzero(chosen)
        doc, value = np.searchsorted(bounds, at, "right") - 1, prints[at]
    size = np.diff(bounds)
    small = np.flatnonzero((size > 0) & (size < SPAN))
    if len(small):
        whole = text.Run(0, data, bounds, bounds[small], bounds[small + 1], np.array([0, len(small)])).word_hashes()
        doc, value = np.append(doc, small), np.append(value, whole)
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    first = np.searchsorted(doc, np.arange(docs + 1))
    count = -(-np.diff(first) // FULL)
    start = np.append(0, np.cumsum(count))
    own = start[doc] + (np.arange(len(doc)) - first[doc]) // FULL
    bits = np.zeros((start[-1], BITS), bool)
    for i in range(MARKS):
        bits[own, ((value >> np.uint64(10 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[start[i] : start[i + 1]] for i in range(docs)]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """From 0 to 1; of two empty chains 1, of one 0."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y):
        x, y = y, x
    a, b = np.bitwise_count(x).sum(1, dtype=np.int64)[:, None], np.bitwise_count(y).sum(1, dtype=np.int64)[None, :]
    common = np.empty((len(x), len(y)), np.int64)
    for i in range(len(x)):
        common[i] = np.bitwise_count(x[i] & y).sum(1, dtype=np.int64)
    most = np.minimum(a, b)
    chance = a * b / BITS
    chance = np.minimum(chance + 2 * np.sqrt(chance * (1 - np.maximum(a, b) / BITS)), most)
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float((score * a[:, 0]).sum() / a.sum())


def shown(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    bounds = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    data = np.frombuffer(b"".join(texts), np.uint8)
    return [c for at, to in text.cuts(bounds) for c in filters(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], rank)]


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id, fingerprint (base64 of the chained filters; "" of a null or empty text) of every row."""

    def each(batch):
        found = chains([(t or "").encode() for t in batch.column(2).to_pylist()], rank)
        yield pa.record_batch([batch.column(1), pa.array(map(shown, found), pa.string())], ["doc_id", "fingerprint"])

    return frames.arrow_map(frames.keyed(docs), each, "doc_id long, fingerprint string")


def followers(docs: DataFrame) -> DataFrame:
    """(_k, follower, need): of each document who comes before it in descending doc_id, cyclically, and a third of that one's length.

    Only ids and lengths are sorted, by ranges; each range's last one takes the next
    range's first from a table of one row a range.
    """
    ids = frames.keyed(docs).groupBy("_k").agg(F.max(F.floor(F.coalesce(F.length("text"), F.lit(0)) / 3)).alias("need"))
    ids = frames.stored(ids.repartitionByRange("_k").withColumn("part", F.spark_partition_id()))
    tops = ids.groupBy("part").agg(F.max("_k").alias("top"))
    order = Window.orderBy("part")
    tops = tops.select("part", F.coalesce(F.lag("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    inner = F.lag("_k").over(Window.partitionBy("part").orderBy("_k"))
    return ids.withColumn("inner", inner).join(tops, "part").select(F.coalesce("inner", "below").alias("_k"), F.col("_k").alias("follower"), "need")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    docs: doc_id, text; others are ignored. A null text counts as empty. A document's
    edited text has its last third of code points replaced by the first as many (or all)
    of the next document in descending doc_id; the last one's next is the first. Rows that
    share a doc_id have the same next document; of several rows that could be that, the
    one of least text hash counts. A null doc_id is the last. A lone document is its own next.
    """
    rank = rarity(docs)
    packed = frames.packed(docs)

    def give(batch):
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [t or "" for t in frames.unpack(part.column(0)).to_pylist()]
            found = chains([t.encode() for t in texts], rank)
            press = zstandard.ZstdCompressor(level=1)
            heads = [press.compress(t[:n].encode()) for t, n in zip(texts, part.column(2).to_pylist(), strict=True)]
            order = [hashlib.md5(t.encode()).digest() for t in texts]
            yield pa.record_batch([part.column(1), pa.array(order, pa.binary()), pa.array(heads, pa.binary()), pa.array([c.tobytes() for c in found], pa.binary())], ["_k", "by", "head", "next"])

    # doc_id goes along unused, so that both joins read the same shuffle of the texts.
    given = frames.arrow_map(packed.join(followers(docs), "_k").select("packed", "follower", "need", "doc_id"), give, "_k long, by binary, head binary, next binary")
    given = given.groupBy("_k").agg(F.min(F.struct("by", "head", "next")).alias("n")).select("_k", "n.head", "n.next")
    both = packed.join(given, "_k").select("doc_id", "packed", "head", "next")

    def each(batch):
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [t or "" for t in frames.unpack(part.column(1)).to_pylist()]
            heads = frames.unpack(part.column(2)).to_pylist()
            edited = [(t[: len(t) - len(t) // 3] + h[: len(t) // 3]).encode() for t, h in zip(texts, heads, strict=True)]
            own, other = chains([t.encode() for t in texts], rank), chains(edited, rank)
            follow = [np.frombuffer(x, np.uint8).reshape(-1, BITS // 8) for x in part.column(3).to_pylist()]
            columns = [
                part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()), pa.array(map(shown, own), pa.string()), pa.array(map(shown, other), pa.string()),
                pa.array(map(likeness, own, other), pa.float64()), pa.array(map(likeness, own, follow), pa.float64()),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return frames.arrow_map(both, each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
