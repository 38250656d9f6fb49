"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces (documents, cut where one is longer than
the longest sequence) are placed longest first, each into the open bin that it fills best;
where none has room, a bin of the least-cost permitted size is opened; at the end each
bin is cut down to the least permitted size that holds its contents.

Pieces of one length are alike, so the plan is made for lengths, not for pieces: from the
number of pieces of each length (at most as many numbers as the longest sequence has
tokens) come patterns, each with the number of bins that follow it. Pieces of a length
are numbered across the cluster, and a piece's number tells its bin and its place there.
The plan's size, and so what the driver holds, depends on the longest sequence alone.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import bpe, frames

#: Permitted sequence lengths in tokens, and what a sequence costs besides its length, in tokens.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096, 8192), 24
LONG_RUN = 4000
_LONG_RUN = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


@dataclass
class Pattern:
    """bins alike: their size, room left, and (length, pieces of it) in the order placed."""

    bins: int
    size: int
    room: int
    holds: tuple[tuple[int, int], ...] = ()


def opened(length: int, count: int, rest: list[tuple[int, int]], capacities: tuple[int, ...], overhead: int, after: int = 0) -> int:
    """The permitted size that costs least for each token it is likely to hold.

    A bin takes as many pieces of this length as there are and fit; what is then left is
    used as far as shorter pieces are known (rest: (length, count) of those still to
    come, longest first, from index ``after``) that go into it.
    """
    best = None
    for size in capacities:
        if size < length:
            continue
        used = min(size // length, count) * length
        left = size - used
        at = after
        while left and (at := bisect_left(rest, -left, at, key=lambda r: -r[0])) < len(rest):
            other, n = rest[at]
            used += other * min(n, left // other)
            left, at = size - used, at + 1
        shrunk = next(c for c in capacities if c >= used)
        cost = (shrunk + overhead) / used
        if best is None or (cost, size) < best:
            best = (cost, size)
    return best[1]


def plan(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[Pattern]:
    """Patterns that place all pieces: counts gives the number of pieces of each length."""
    capacities = tuple(sorted(capacities))
    lengths = sorted((x for x in counts if counts[x]), reverse=True)
    if lengths and (lengths[0] > capacities[-1] or lengths[-1] < 1):
        raise ValueError("a piece must have from one token to as many as the longest sequence")
    open_by: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(pattern: Pattern) -> None:
        if not pattern.bins:
            return
        if pattern.room < lengths[-1]:
            done.append(pattern)
            return
        if pattern.room not in open_by:
            open_by[pattern.room] = []
            insort(rooms, pattern.room)
        open_by[pattern.room].append(pattern)

    def fill(pattern: Pattern, length: int, n: int) -> int:
        """As many bins of pattern as n pieces fill are put back with them; the pieces that are left."""
        each = pattern.room // length
        whole, part = min(pattern.bins, n // each), n % each if n // each < pattern.bins else 0
        put(Pattern(whole, pattern.size, pattern.room - each * length, (*pattern.holds, (length, each))))
        if part:
            put(Pattern(1, pattern.size, pattern.room - part * length, (*pattern.holds, (length, part))))
        put(Pattern(pattern.bins - whole - bool(part), pattern.size, pattern.room, pattern.holds))
        return n - whole * each - part

    known = [(x, counts[x]) for x in lengths]
    for i, length in enumerate(lengths):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                size = opened(length, n, known, capacities, overhead, i + 1)
                n = fill(Pattern(-(-n // (size // length)), size, size), length, n)
                continue
            room = rooms[at]
            own = open_by[room]
            n = fill(own.pop(), length, n)
            if not own and not open_by.get(room):
                open_by.pop(room, None)
                if (k := bisect_left(rooms, room)) < len(rooms) and rooms[k] == room:
                    rooms.pop(k)
    done += [p for own in open_by.values() for p in own]
    for pattern in done:  # downsize
        pattern.size = next(c for c in capacities if c >= pattern.size - pattern.room)
        pattern.room = pattern.size - sum(a * b for a, b in pattern.holds)
    return sorted(done, key=lambda p: (-p.size, p.holds, p.bins))


def pieces(docs: DataFrame, tokens: Column, longest: int) -> DataFrame:
    """_k, doc_id, piece (from 0), length: each document of at least a token, cut into runs of at most ``longest`` tokens."""
    counted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(frames.NO_ID)).alias("_k"), F.col("doc_id").cast("long").alias("doc_id"), tokens.cast("long").alias("n")).where("n > 0")
    cut = counted.select("_k", "doc_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {longest})")).alias("piece"))
    return cut.select("_k", "doc_id", "piece", F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("length"))


def words(text: str = "text") -> Column:
    """A measure that needs no tokenizer: words of a text and one end mark; none of a null text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1


def packed(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, length, bin, start, bin_size, bin_used: where each piece of each document lies.

    docs: doc_id and what ``tokens`` reads (text, by default); others are ignored. A document
    whose tokens are null or 0 has no piece. Repeated rows are packed each. bin numbers from
    0 without gaps; start is the piece's first token in its bin. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    longest = max(capacities)
    own = frames.stored(pieces(docs, words() if tokens is None else tokens, longest).repartitionByRange("length", "_k", "piece").withColumn("part", F.spark_partition_id()))
    by_part = own.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    offsets = by_part.select("length", "part", before.alias("offset"))
    within = F.row_number().over(Window.partitionBy("part", "length").orderBy("_k", "piece"))
    numbered = own.withColumn("within", within.cast("long") - 1).join(offsets, ["length", "part"]).select("doc_id", "piece", "length", (F.col("within") + F.col("offset")).alias("number"))

    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows, first_bin, used = [], 0, dict.fromkeys(counts, 0)
    for pattern in plan(counts, capacities, overhead):
        start = 0
        for length, each in pattern.holds:
            rows.append((length, used[length], used[length] + each * pattern.bins, each, first_bin, start, pattern.size, pattern.size - pattern.room))
            used[length] += each * pattern.bins
            start += length * each
        first_bin += pattern.bins
    table = spark.createDataFrame(rows, "length long, low long, high long, each long, first_bin long, first_start long, bin_size long, bin_used long")
    placed = numbered.join(F.broadcast(table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "first_bin", "first_start", "bin_size", "bin_used"))).alias("slots"))), "length")
    slot = F.element_at(F.filter("slots", lambda s: (s["low"] <= F.col("number")) & (F.col("number") < s["high"])), 1)
    placed = placed.select("doc_id", "piece", "length", "number", slot.alias("s"))
    at = F.col("number") - F.col("s.low")
    return placed.select("doc_id", "piece", "length", (F.col("s.first_bin") + F.floor(at / F.col("s.each"))).cast("long").alias("bin"), (F.col("s.first_start") + at % F.col("s.each") * F.col("length")).cast("long").alias("start"), "s.bin_size", "s.bin_used")


@lru_cache(2)
def _library(path: str, pattern: str) -> tiktoken.Encoding:
    """One a worker process."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def id_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_ids of every row of docs: how many ids the ranks in a file give its text, none of them special; null of a null text.

    The library counts, but texts with a run of LONG_RUN characters without space, which it may
    merge in quadratic time, go to the encoder of this package.
    """

    def each(batch):
        own, sizes = _library(path, pattern), []
        for x in batch.column(2):
            line = x.as_py()
            if line is None:
                sizes.append(None)
            elif _LONG_RUN.search(line):
                sizes.append(len(bpe.encoder(path, pattern).encode([line])[0]))
            else:
                sizes.append(len(own.encode_ordinary(line)))
        yield pa.record_batch([batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "n_ids"])

    return frames.arrow_map(frames.keyed(docs), each, "doc_id long, n_ids long")


def packed_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """packed() by the ids that a rank file gives each text, and one end mark; none of a null text.

    The counts are written first, as packed() reads its table several times.
    """
    return packed(frames.stored(id_counts(docs, path, pattern)), F.col("n_ids") + 1)
