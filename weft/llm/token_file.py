"""Token-id files: documents' ids in blocks that an adaptive context-mixing range coder compresses.

A file row is a segment: whole documents in ascending doc_id order, their ids cut into
blocks of ``BLOCK``. Each block starts from an empty model and has its own checksum, of its
ids and its bytes, so that one can be read, or found damaged, without another. The blocks of a segment are
coded side by side: each numpy operation does one step of all of them.

A block predicts the next id from the last two (order 2), from the last one (order 1) and
from none (order 0: how often each id stands in the segment, as its index says). Whether the
id is order 2's guess is coded with a probability that mixes three: by that guess's record, by
order 1's record and whether it agrees, and by order 0's frequency of the guess; then whether it
is order 1's guess, by its record and its frequency; and else the id, by order 0 alone. All these
probabilities adapt within the block, and so do the weights by which they are mixed (in the
logistic domain, each moved by its share in the error). Only whole numbers are computed, so
that any machine reads what another wrote.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import bpe, frames

BLOCK, LANES = 4096, 1024
MAGIC = 0x32544657
#: Slots of the guesses of either order, how fast probabilities follow (a shift), bits of order 0's frequencies.
_SLOTS, _RATE, _BITS = 4096, 5, 20
_WORD, _LOW, _32 = np.uint64(1 << 32), np.uint64(0xFFFFFFFF), np.uint64(32)
#: ln(p / (1 - p)) of p in 1/4096, times 256, and back, rounded.
_STRETCH = np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))).astype(np.int64)
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, 4095).astype(np.int64)


class Frequencies:
    """Order 0: the frequency of each id of a segment in 2 ** _BITS, at least 1 where it occurs."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        """The ids that occur, in order, and their frequencies."""
        self.ids, self.sizes = ids.astype(np.int64), sizes.astype(np.int64)
        self.size = np.zeros(int(ids[-1]) + 2 if len(ids) else 2, np.int64)
        self.size[self.ids] = self.sizes
        self.start = np.cumsum(self.size) - self.size
        self._own = self.start[self.ids]
        self.level = np.frexp(self.size.astype(np.float64))[1]

    @classmethod
    def of(cls, ids: np.ndarray) -> Frequencies:
        found, count = np.unique(ids, return_counts=True)
        sizes = 1 + count * ((1 << _BITS) - len(found)) // max(len(ids), 1)
        if len(found):
            sizes[sizes.argmax()] += (1 << _BITS) - sizes.sum()
        return cls(found, sizes)

    def at(self, slots: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self._own, slots, "right") - 1]

    def pack(self) -> bytes:
        return zlib.compress(np.concatenate([np.diff(self.ids, prepend=0), self.sizes]).astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Frequencies:
        steps, sizes = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1).astype(np.int64)
        return cls(np.cumsum(steps), sizes)


class _Mixer:
    """A binary probability for each of n blocks, mixed from several adaptive ones by weights that adapt."""

    def __init__(self, n: int, contexts: tuple[int, ...]):
        self.tables = [np.full(n * c, 1 << 15, np.int32) for c in contexts]
        self.rows = [np.arange(n) * c for c in contexts]
        self.weights = np.full((len(contexts), n), (1 << 17) // len(contexts) // 2 + (1 << 14), np.int64)

    def chance(self, lanes: slice | np.ndarray, contexts: tuple[np.ndarray, ...]) -> np.ndarray:
        """In 1/65536, that the answer is yes in these blocks; contexts: which entry of each table applies."""
        self.lanes = lanes
        self.spots = [rows[lanes] + c for rows, c in zip(self.rows, contexts, strict=True)]
        self.was = [table[spot] for table, spot in zip(self.tables, self.spots, strict=True)]
        self.stretched = [_STRETCH[x >> 4] for x in self.was]
        total = sum(w[lanes] * x for w, x in zip(self.weights, self.stretched, strict=True)) >> 16
        self.mixed = _SQUASH[np.clip(total, -2047, 2047) + 2047]
        return self.mixed << 4

    def learn(self, yes: np.ndarray) -> None:
        error = ((yes.astype(np.int64) << 12) - self.mixed) * 6
        full = yes.astype(np.int32) * 65535
        for weight, x, table, spot, was in zip(self.weights, self.stretched, self.tables, self.spots, self.was, strict=True):
            weight[self.lanes] += (x * error + 0x2000) >> 14
            table[spot] = was + ((full - was) >> _RATE)


class _Model:
    """Predictions for n blocks at once."""

    def __init__(self, n: int, order0: Frequencies):
        self.rows = np.arange(n) * _SLOTS
        self.level = order0.level
        self.none = len(order0.level) - 1  # no guess yet: an id that does not occur
        self.guess = [np.full(n * _SLOTS, self.none, np.int32) for _ in range(2)]
        self.record = [np.zeros(n * _SLOTS, np.uint8) for _ in range(2)]
        self.two_right, self.one_right = _Mixer(n, (4, 8, _BITS + 2)), _Mixer(n, (4, _BITS + 2))
        self.last = np.zeros(n, np.int64)
        self.before = np.zeros(n, np.int64)

    def look(self, n: int) -> np.ndarray:
        """How likely order 2's guess is right in each of the first n blocks."""
        self.live = live = slice(n)
        last, rows = self.last[live], self.rows[live]
        self.at = [rows + (last & (_SLOTS - 1)), rows + ((last * 0x9E3B + self.before[live] * 0x5F35) >> 3 & (_SLOTS - 1))]
        self.one, self.two = self.guess[0][self.at[0]], self.guess[1][self.at[1]]
        self.records = [self.record[k][self.at[k]] for k in range(2)]
        self.agree = self.one == self.two
        return self.two_right.chance(live, (self.records[1].astype(np.int64), 2 * self.records[0].astype(np.int64) + self.agree, self.level[self.two]))

    def look_again(self, asked: np.ndarray) -> np.ndarray:
        """How likely order 1's guess is right, where order 2's was another and wrong; asked: of those looked at, which."""
        return self.one_right.chance(asked, (self.records[0][asked].astype(np.int64), self.level[self.one[asked]]))

    def learn(self, ids: np.ndarray, hit: np.ndarray, right: np.ndarray) -> None:
        self.two_right.learn(hit)
        self.one_right.learn(right)
        for k, known in ((0, self.one), (1, self.two)):
            at, was = self.at[k], self.records[k]
            same = known == ids
            self.record[k][at] = np.where(same, np.minimum(was + 1, 3), np.maximum(was, 1) - 1)
            self.guess[k][at] = np.where(same | (was > 0), known, ids)
        self.before[self.live] = self.last[self.live]
        self.last[self.live] = ids


def _sides(yes: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(yes, 0, chance), np.where(yes, chance, (1 << 16) - chance)


def compress(blocks: np.ndarray, sizes: np.ndarray, order0: Frequencies) -> list[bytes]:
    """blocks: one row of ids of order0 each; sizes: how many of a row count, at least 1, not rising from row to row."""
    n = len(sizes)
    low, width = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out, fill = np.zeros((n, blocks.shape[1] // 2 + 64), np.uint32), np.zeros(n, np.int64)
    model = _Model(n, order0)

    def emit(lanes, start, size, bits):
        nonlocal out
        part = width[lanes] >> np.uint64(bits)
        at, wide = low[lanes] + part * start.astype(np.uint64), part * size.astype(np.uint64)
        small = np.flatnonzero(wide < _WORD)
        if len(small):
            l, w = at[small], wide[small]
            w = np.where((l ^ (l + w)) >= _WORD, (np.uint64(0) - l) & _LOW, w)
            own = small if isinstance(lanes, slice) else lanes[small]
            if fill[own].max() >= out.shape[1]:
                out = np.pad(out, ((0, 0), (0, out.shape[1])))
            out[own, fill[own]] = (l >> _32).astype(np.uint32)
            fill[own] += 1
            at[small], wide[small] = l << _32, w << _32
        low[lanes], width[lanes] = at, wide

    for t in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -t, "left"))
        ids = blocks[:n, t]
        chance = model.look(n)
        hit = ids == model.two
        emit(slice(n), *_sides(hit, chance), 16)
        asked = np.flatnonzero(~hit & ~model.agree)
        chance = model.look_again(asked)
        right = ids[asked] == model.one[asked]
        emit(asked, *_sides(right, chance), 16)
        plain = ~hit
        plain[asked[right]] = False
        plain = np.flatnonzero(plain)
        emit(plain, order0.start[ids[plain]], order0.size[ids[plain]], _BITS)
        model.learn(ids, hit, right)
    tail = np.stack([low >> _32, low & _LOW], 1).astype("<u4")
    return [np.append(out[i, : fill[i]].astype("<u4"), tail[i]).tobytes() for i in range(len(sizes))]


def expand(payloads: list[bytes], sizes: np.ndarray, order0: Frequencies) -> np.ndarray:
    """The ids of compress() again; a payload that is too short reads as if zeros followed."""
    n = len(payloads)
    most = max((len(p) // 4 for p in payloads), default=0) + 2
    words = np.zeros((n, most), np.uint32)
    for i, p in enumerate(payloads):
        own = np.frombuffer(p, "<u4", len(p) // 4)
        words[i, : len(own)] = own
    code, low, width = words[:, 0].astype(np.uint64) << _32 | words[:, 1], np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    taken = np.full(n, 2)
    blocks = np.zeros((n, int(sizes.max(initial=0))), np.int32)
    model = _Model(n, order0)

    def take(lanes, start, size, bits):
        part = width[lanes] >> np.uint64(bits)
        at, wide = low[lanes] + part * start.astype(np.uint64), part * size.astype(np.uint64)
        small = np.flatnonzero(wide < _WORD)
        if len(small):
            l, w = at[small], wide[small]
            w = np.where((l ^ (l + w)) >= _WORD, (np.uint64(0) - l) & _LOW, w)
            own = small if isinstance(lanes, slice) else lanes[small]
            code[own] = code[own] << _32 | words[own, np.minimum(taken[own], most - 1)]
            taken[own] += 1
            at[small], wide[small] = l << _32, w << _32
        low[lanes], width[lanes] = at, wide

    def asks(lanes, chance):
        yes = code[lanes] - low[lanes] < (width[lanes] >> np.uint64(16)) * chance.astype(np.uint64)
        take(lanes, *_sides(yes, chance), 16)
        return yes

    for t in range(blocks.shape[1]):
        n = int(np.searchsorted(-sizes, -t, "left"))
        hit = asks(slice(n), model.look(n))
        ids = model.two.astype(np.int64)
        asked = np.flatnonzero(~hit & ~model.agree)
        right = asks(asked, model.look_again(asked))
        ids[asked] = model.one[asked]
        plain = ~hit
        plain[asked[right]] = False
        plain = np.flatnonzero(plain)
        slot = np.minimum((code[plain] - low[plain]) // np.maximum(width[plain] >> np.uint64(_BITS), np.uint64(1)), np.uint64((1 << _BITS) - 1)).astype(np.int64)
        ids[plain] = order0.at(slot)
        take(plain, order0.start[ids[plain]], order0.size[ids[plain]], _BITS)
        model.learn(ids, hit, right)
        blocks[:n, t] = ids
    return blocks


def _block_sizes(n: int) -> np.ndarray:
    sizes = np.full(-(-n // BLOCK), BLOCK)
    if n % BLOCK:
        sizes[-1] = n % BLOCK
    return sizes


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents and their ids as one segment: header, index (with order 0 and each block's size and checksum), blocks."""
    sizes = _block_sizes(len(ids))
    blocks = np.zeros((len(sizes), BLOCK), np.int32)
    blocks.ravel()[: len(ids)] = ids
    order0 = Frequencies.of(ids)
    payloads = [p for at in range(0, len(sizes), LANES) for p in compress(blocks[at : at + LANES], sizes[at : at + LANES], order0)]
    flat = ids.astype("<u4")
    sums = [zlib.crc32(p, zlib.crc32(flat[at : at + BLOCK].tobytes())) for at, p in zip(range(0, len(ids), BLOCK), payloads, strict=True)]
    known = order0.pack()
    body = b"".join([np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), np.array(list(map(len, payloads)), "<u4").tobytes(), np.array(sums, "<u4").tobytes(), known])
    head = np.array([MAGIC, len(doc_ids), len(sizes), len(known), zlib.crc32(body)], "<u4").tobytes()
    return head + body + b"".join(payloads)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment; ValueError where a checksum doesn't hold."""
    magic, docs, count, known, check = np.frombuffer(data, "<u4", 5).tolist()
    end = 20 + 16 * docs + 8 * count
    if magic != MAGIC or zlib.crc32(data[20 : end + known]) != check:
        raise ValueError("damaged index of a token segment")
    doc_ids, lengths = np.frombuffer(data, "<i8", docs, 20), np.frombuffer(data, "<i8", docs, 20 + 8 * docs)
    long, sums = np.frombuffer(data, "<u4", count, 20 + 16 * docs), np.frombuffer(data, "<u4", count, 20 + 16 * docs + 4 * count)
    order0 = Frequencies.unpack(data[end : end + known])
    bounds = end + known + np.append(0, np.cumsum(long, dtype=np.int64))
    sizes = _block_sizes(int(lengths.sum()))
    payloads = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    parts = []
    for at in range(0, count, LANES):
        blocks = expand(payloads[at : at + LANES], sizes[at : at + LANES], order0)
        for row, payload, size, check in zip(blocks, payloads[at : at + LANES], sizes[at : at + LANES].tolist(), sums[at : at + LANES].tolist(), strict=True):
            part = row[:size].astype("<u4")
            if zlib.crc32(payload, zlib.crc32(part.tobytes())) != check:
                raise ValueError("damaged block of a token segment")
            parts.append(part)
    return doc_ids, lengths, np.concatenate(parts) if parts else np.zeros(0, "<u4")


class LibraryEncoder(bpe.Remembering):
    """Ids by the tokenizers library, of each distinct pre-token once.

    special: added tokens in a text become their ids, as the library does by default; a text
    that holds one is encoded whole.
    """

    def __init__(self, path: str, pattern: str, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__(pattern)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self._added = re.compile("|".join(map(re.escape, added))) if added else None

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if t and self._added.search(t)] if self._added else []
        if not whole:
            return super().encode(texts)
        held = set(whole)
        ids, bounds = super().encode([None if i in held else t for i, t in enumerate(texts)])
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i, found in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            parts[i] = np.array(found.ids, ids.dtype)
        return np.concatenate(parts), np.append(0, np.cumsum(list(map(len, parts)), dtype=np.int64))

    def _learn(self, new: list[str]) -> None:
        for word, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self._newer[word] = tuple(found.ids)


@lru_cache(2)
def library_encoder(path: str, pattern: str, special: bool = False) -> LibraryEncoder:
    return LibraryEncoder(path, pattern, special)


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0, special: bool = False) -> None:
    """Writes the ids of every row of docs (doc_id, text; others are ignored) as files under path.

    path: a folder that all executors see. tokenizer: a byte-level BPE file of the
    tokenizers library that every executor has; pattern: its split; special: whether its added
    tokens are found in texts, as the library does by default. Each text's ids are
    followed by end_id; a null or empty text has that one only. Files are in ascending
    doc_id order, a null doc_id first; rows that share a doc_id follow each other. Columns:
    part and segment (the order), docs, tokens, data (see write_segment).
    """
    ordered = frames.packed(docs).repartitionByRange("_k").sortWithinPartitions("_k", "packed").withColumn("part", F.spark_partition_id())

    def over(batches):
        encoder, number, keys, lengths, ids, held = library_encoder(tokenizer, pattern, special), 0, [], [], [], 0

        def segment(part):
            size = np.concatenate(lengths)
            data = write_segment(np.concatenate(keys), size, np.concatenate(ids))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(size)], pa.int64()), pa.array([int(size.sum())], pa.int64()), pa.array([data], pa.binary())], ["part", "segment", "docs", "tokens", "data"])

        part = None
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 128):
                part = batch.column(3)[at].as_py()
                found, bounds = encoder.encode(frames.unpack(batch.column(2)[at : at + 128]).to_pylist())
                ids.append(np.insert(found.astype(np.int32), bounds[1:], end_id))
                lengths.append(np.diff(bounds) + 1)
                keys.append(own[at : at + 128])
                held += len(ids[-1])
                if held >= BLOCK * LANES:
                    yield segment(part)
                    number, keys, lengths, ids, held = number + 1, [], [], [], 0
        if keys:
            yield segment(part)

    ordered.select("_k", "doc_id", "packed", "part").mapInArrow(over, "part int, segment long, docs long, tokens long, data binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, ids (array of int) of each document in files of write(); start counts the ids before it in all of them."""
    files = spark.read.schema("part int, segment long, docs long, tokens long, data binary").parquet(path)
    sizes = files.select("part", "segment", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("tokens")
    base = sizes.withColumn("inner", inner).join(parts, "part").select("part", "segment", (F.col("inner") + F.col("before")).alias("base"))

    def each(batch):
        for i in range(batch.num_rows):
            keys, lengths, ids = read_segment(batch.column(1)[i].as_py())
            bounds = np.append(0, np.cumsum(lengths))
            for at in range(0, len(keys), 256):
                cut = bounds[at : at + 257]
                own = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(ids[cut[0] : cut[-1]].astype(np.int32)))
                some = keys[at : at + 256]
                yield pa.record_batch([pa.array(some, pa.int64(), mask=some == frames.NO_ID), pa.array(batch.column(0)[i].as_py() + cut[:-1]), own], ["doc_id", "start", "ids"])

    return frames.arrow_map(files.join(base, ["part", "segment"]).select("base", "data"), each, "doc_id long, start long, ids array<int>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read()'s rows."""

    def each(batch):
        sums = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in batch.column(2)]
        sizes = [len(x.values) for x in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return frames.arrow_map(found.select("doc_id", "start", "ids"), each, "doc_id long, start long, n_tokens long, ids_crc32 long")
