"""Substring dedup by suffix trees of prefix-partitioned groups.

A suffix is the word sequence from one word of a document on; whether the ``window`` words it
begins with repeat is settled at that depth of the suffix tree, so trees are built no deeper.

1. *Prefix census.* Suffixes that begin within a window's reach of each other are partitioned
   together by the least label, a prefix of ``prefix`` words, among the suffixes of the window:
   equal windows have equal least labels, at equal places. These places are about an eighth of
   all words. A label that stands in one place of the corpus has one suffix of each kind below
   it, so no internal node: its suffixes are dropped before any is sent. A label with more than
   ``group`` places would make a group that outgrows memory, so its prefix is extended to the
   whole window, the longest that is ever needed.
2. *Trees.* For each place of another label its words are sent once, with those of the windows
   that it stands for. A task takes whole groups of at most ``group`` places at a time and sorts
   their suffixes by prefix doubling: ranks by 1, 2, 4, 8, ... words are the tree's nodes at these
   depths, and a node of ``window`` words is internal if several suffixes have its rank. Its
   suffix of least (doc_id, start) comes first. The suffixes of extended prefixes are such nodes
   as they are; a partial aggregation before their shuffle leaves one row a task of a passage
   that a third of all documents share.
3. *Marking.* Documents get the starts at which they are a node's first suffix. Each other
   suffix that was not dropped is a repeat, and overlapping repeats join into the maximal ones.

Nothing is gathered by passage: what meets in a task is a bounded group, or one document's own
list. Words are compared by 64 bits of their hash, extended prefixes by 96 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from weft.llm import frames, text
from weft.llm.text import Run

#: Words in a window, and in a label; places of a label from which its prefix is extended; words whose suffixes are sorted together.
WINDOW, PREFIX, GROUP, SORTED = 20, 6, 4096, 1 << 19
_PLACE = np.uint64((1 << 24) - 1)


def _anchors(run: Run, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of all places; the place of each window's least label (its first, if several); which windows lie in one document."""
    labels = text.sequences(run.word_hashes(), prefix)
    marked = (labels & ~_PLACE) | (np.arange(len(labels), dtype=np.uint64) & _PLACE)
    least = (text.sliding(marked, window - prefix + 1) & _PLACE).astype(np.int64)
    if len(labels) > int(_PLACE):
        least += (np.arange(len(least)) - least + int(_PLACE)) // (int(_PLACE) + 1) * (int(_PLACE) + 1)
    return labels, least, run.inside(window)


def _census(run: Run, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, label, places of it there) of the least labels of a document's windows."""
    labels, least, inside = _anchors(run, window, prefix)
    place = np.unique(least[inside])
    doc, label = run.doc[place], labels[place]
    order = np.lexsort((label, doc))
    doc, label = doc[order], label[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    at = np.flatnonzero(new)
    return doc[at], label[at], np.diff(np.append(at, len(doc)))


def _among(doc: np.ndarray, value: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """For each (document, value), whether value is in that document's list."""
    out, at = np.zeros(len(doc), bool), 0
    bounds = np.searchsorted(doc, np.arange(len(lists) + 1))
    for i, own in enumerate(lists):
        at, to = bounds[i], bounds[i + 1]
        if len(own) and to > at:
            own = np.sort(own)
            place = np.minimum(np.searchsorted(own, value[at:to]), len(own) - 1)
            out[at:to] = own[place] == value[at:to]
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[bounds[i] : bounds[i + 1]] if ok else values[:0] for i, ok in enumerate(column.is_valid().to_pylist())]


def _sent(run: Run, leaves: list[np.ndarray], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows whose label is not one of one place: their document, first word in the run, place and label."""
    labels, least, inside = _anchors(run, window, prefix)
    at = np.flatnonzero(inside)
    doc, place = run.doc[at], least[at]
    keep = ~_among(doc, labels[place], leaves)
    return doc[keep], at[keep], place[keep], labels[place[keep]]


def _joined(run: Run, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each (first word, number of words), these words with single spaces between."""
    word = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    size = run.end[word] - run.start[word] + 1
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    length = size - 1
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[place + np.repeat(to, length)] = run.data[place + np.repeat(run.start[word], length)]
    bounds = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))]
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def _nodes(hashes: np.ndarray, inside: np.ndarray, window: int) -> np.ndarray:
    """For each word of sequences that follow each other, the node of the ``window`` words from it on, or -1.

    inside: how many words of its sequence a word has after it, itself included.
    """
    level = np.unique(hashes, return_inverse=True)[1]
    node, depth, done, left = None, 1, 0, window
    while True:
        if left & 1:
            node, done = (level, depth) if node is None else (_deeper(node, level, done, inside, done + depth), done + depth)
        left >>= 1
        if not left:
            return node
        level, depth = _deeper(level, level, depth, inside, 2 * depth), 2 * depth


def _deeper(upper: np.ndarray, lower: np.ndarray, depth: int, inside: np.ndarray, wanted: int) -> np.ndarray:
    """Ranks of pairs of a rank and that of ``depth`` words on; -1 where a sequence has less than ``wanted`` words left."""
    out = np.full(len(upper), -1, np.int64)
    at = np.flatnonzero(inside >= wanted)
    if len(at):
        out[at] = np.unique(upper[at] << 32 | lower[at + depth], return_inverse=True)[1]
    return out


def _first_suffixes(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """(_k, start) of the first suffix of each node of whole groups (label, _k, start, windows, words)."""
    hashes, length = [], []
    for run in text.runs(batch.column(4)):
        hashes.append(run.word_hashes())
        length.append(np.diff(run.words))
    length = np.concatenate(length)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    node = _nodes(np.concatenate(hashes), length[row] - place, window)
    at = np.flatnonzero(place < batch.column(3).to_numpy()[row])
    k, start = batch.column(1).to_numpy()[row[at]], batch.column(2).to_numpy()[row[at]] + place[at]
    order = np.lexsort((start, k, node[at]))
    new = np.ones(len(order), bool)
    new[1:] = node[at[order]][1:] != node[at[order]][:-1]
    return pa.record_batch([pa.array(k[order[new]]), pa.array(start[order[new]])], ["_k", "start"])


def _whole_groups(batches, most: int):
    """Sorted rows (label, .., windows, words) anew, in record batches of whole labels and, beyond one label, of some ``most`` words."""
    held, words = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        words += int(batch.column(3).to_numpy().sum()) + 20 * batch.num_rows
        if words >= most:
            whole = _one(held)
            label = whole.column(0).to_numpy()
            if cut := int(np.searchsorted(label, label[-1])):
                yield whole.slice(0, cut)
            held, words = [whole.slice(cut)], words * (len(label) - cut) // len(label)
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, rest: bool = False, group: int = GROUP) -> DataFrame:
    """One row for each document with what a further stage needs to cut its repeats.

    docs: doc_id, text. Returns _k, doc_id, packed (the text,
    zstd), leaves and firsts, which _cut() reads, and with ``rest`` the other columns. Rows that share a doc_id count as one document
    that is written several times: a window's first place is (doc_id, start), and each row
    that has it there keeps it. A null doc_id comes before all others. A null or empty
    text, or one of fewer words than the window, has no window. An empty table gives an
    empty result. group: places of a label that a tree is built over, at most.
    """
    if window < prefix:
        raise ValueError("the prefix must not be longer than the window")

    def census(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for run in text.runs(batch.column(2)):
            doc, label, places = _census(run, window, prefix)
            yield pa.record_batch([pa.array(text.signed(label)), pa.array(keys[run.first + doc]), pa.array(places, pa.int64())], ["label", "_k", "places"])

    marks = frames.arrow_map(frames.keyed(docs), census, "label long, _k long, places long")
    known = marks.groupBy("label").agg(F.min("_k").alias("_k"), F.sum("places").alias("places")).where(f"places = 1 or places > {group}")
    known = frames.stored(known)
    leaves = known.where("places = 1").groupBy("_k").agg(F.collect_list("label").alias("leaves"))
    long = known.where(f"places > {group}").select("label")
    extended = marks.join(long, "label").groupBy("_k").agg(F.collect_set("label").alias("extended"))
    more = ["rest"] if rest else []
    held = frames.packed(docs, rest).join(leaves, "_k", "left").join(extended, "_k", "left").select("_k", "doc_id", "packed", "leaves", "extended", *more)

    def picked(batch):
        """For each run its rows' _k and the windows of labels of several places, with whether their prefix is extended."""
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        leaf, longer = ([text.unsigned(x) for x in _lists(batch.column(i))] for i in (3, 4))
        for run in text.runs(frames.unpack(batch.column(2))):
            own = slice(run.first, run.first + run.size)
            doc, at, place, label = _sent(run, leaf[own], window, prefix)
            yield run, keys[own], doc, at, place, label, _among(doc, label, longer[own])

    def places(batch):
        for run, keys, doc, at, place, label, far in picked(batch):
            doc, at, place, label = doc[~far], at[~far], place[~far], label[~far]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            windows = np.diff(np.append(first, len(at)))
            d, w = doc[first], at[first]
            yield pa.record_batch([pa.array(text.signed(label[first])), pa.array(keys[d]), pa.array(w - run.words[d]), pa.array(windows, pa.int32()), _joined(run, w, windows + window - 1)], ["label", "_k", "start", "windows", "words"])

    def trees(batches):
        for groups in _whole_groups(batches, SORTED):
            yield _first_suffixes(groups, window)

    def longest(batch):
        """The first suffix in the batch of each whole window whose prefix is extended."""
        parts, batch = [], batch.filter(batch.column(4).is_valid())
        if not batch.num_rows:
            return
        for run, keys, doc, at, _, _, far in picked(batch):
            d, w, hashes = doc[far], at[far], run.word_hashes()
            parts.append((text.sequences(hashes, window)[w], text.sequences(hashes, window, 1)[w] >> np.uint64(32), keys[d], w - run.words[d]))
        node, check, k, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, k, check, node))
        node, check, k, start = node[order], check[order], k[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (node[1:] != node[:-1]) | (check[1:] != check[:-1])
        yield pa.record_batch([pa.array(text.signed(node[new])), pa.array(check[new].astype(np.uint32).view(np.int32)), pa.array(k[new]), pa.array(start[new])], ["node", "check", "_k", "start"])

    grouped = frames.arrow_map(held.select("_k", "doc_id", "packed", "leaves", "extended"), places, "label long, _k long, start long, windows int, words binary")
    inner = grouped.repartition("label").sortWithinPartitions("label").mapInArrow(trees, "_k long, start long")
    # All documents go to both, so that both read one shuffle of the texts.
    alone = frames.arrow_map(held.select("_k", "doc_id", "packed", "leaves", "extended"), longest, "node long, check int, _k long, start long")
    nodes = alone.groupBy("node", "check").agg(F.min(F.struct("_k", "start")).alias("first")).select("first.*")
    firsts = inner.unionByName(nodes).groupBy("_k").agg(F.collect_list("start").alias("firsts"))
    return held.join(firsts, "_k", "left").select("_k", "doc_id", "packed", "leaves", "firsts", *more)


def _cut(batch: pa.RecordBatch, window: int, prefix: int):
    """For each document: row, number of words, number of words cut, kept words joined by spaces."""
    leaf, firsts = [text.unsigned(x) for x in _lists(batch.column(3))], _lists(batch.column(4))
    for run in text.runs(frames.unpack(batch.column(2))):
        own = slice(run.first, run.first + run.size)
        doc, at, _, _ = _sent(run, leaf[own], window, prefix)
        again = at[~_among(doc, at - run.words[doc], firsts[own])]
        n = len(run.start)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        kept = np.cumsum(cover[:n]) == 0
        removed = text.per_doc(run, ~kept)
        size = run.end - run.start + 1  # with a space after it
        out = np.full(int(size[kept].sum()), 0x20, np.uint8)
        length = size[kept] - 1
        to = np.cumsum(size[kept]) - size[kept]
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[place + np.repeat(to, length)] = run.data[place + np.repeat(run.start[kept], length)]
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(np.where(kept, size, 0), out=ends[1:])
        ends = ends[run.words]
        for i in range(run.size):
            yield run.first + i, int(run.words[i + 1] - run.words[i]), int(removed[i]), out[ends[i] : max(ends[i], ends[i + 1] - 1)]


def digests(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs; see repeats() for odd rows."""

    def each(batch):
        rows, n, gone, digest = zip(*((i, a, b, hashlib.sha256(t).hexdigest()) for i, a, b, t in _cut(batch, window, prefix)), strict=True)
        yield pa.record_batch([batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return frames.arrow_map(repeats(docs, window, prefix, group=group), each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs, all its columns, each text without its repeats.

    A document that loses nothing keeps its text as it was (null stays null); another
    becomes its kept words joined by single spaces, which may be empty.
    """
    source = repeats(docs, window, prefix, rest=True)
    schema = StructType().add("doc_id", LongType()).add("text", StringType()).add(source.schema["rest"])

    def each(batch):
        was = frames.unpack(batch.column(2)).to_pylist()
        texts = [was[i] if not gone else t.tobytes().decode() for i, _, gone, t in _cut(batch, window, prefix)]
        yield pa.record_batch([batch.column(1), pa.array(texts, pa.string()), batch.column(5)], schema.names)

    return frames.restored(frames.arrow_map(source, each, schema), docs)
