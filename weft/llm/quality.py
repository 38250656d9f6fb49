"""Quality rules: base counts of a text, and gradient-boosted trees over its statistics.

The trees are grown here, on a bounded sample of labelled rows, with histograms of at
most ``BINS`` bins a feature and second-order gains of the logistic loss. Chosen features
are monotonic: a split on one must order its children, and bounds at the mid-point hold
for all that is grown below. For scoring the trees are flattened into numpy arrays (one
row of nodes a tree), and all documents of a batch step down all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import frames, text
from weft.llm.text import Run

#: Labelled rows (those of least hash) that the trees are fitted to, at most.
FIT_ROWS = 12_000
ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 4.0
#: A document is dropped where its probability of good quality is below this.
KEEP = 0.35
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "bang_share", "pipe_share", "distinct_share", "line_words", "top_word_share", "long_share", "other_share")
#: Sign of a feature's allowed effect on quality; the others are free.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KIND = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 other ASCII punctuation, 4 !, 5 |, 6 a lead byte above ASCII
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[ord("!")], _KIND[ord("|")] = 4, 5
_KIND[0xC0:] = 6


def _sums(bounds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _counts(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """BASE and FEATURES of each document of a run."""
    n, size = run.size, np.diff(run.words)
    lead = (run.data & 0xC0) != 0x80
    gap = text._SEPARATOR[run.data]
    chars, symbols = _sums(run.begin, lead & ~gap), _sums(run.begin, _SYMBOL[run.data])
    kinds = _KIND[run.data]
    by_kind = [_sums(run.begin, kinds == k) for k in range(1, 7)]

    hashes = run.word_hashes()
    doc = run.doc
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = per = np.bincount(doc[order][new], minlength=n) if len(order) else np.zeros(n, np.int64)
    top = np.zeros(n, np.int64)
    if len(order):
        at = np.flatnonzero(new)
        np.maximum.at(top, doc[order][at], np.diff(np.append(at, len(order))))

    three, inside = text.sequences(hashes, 3), run.inside(3)
    again = np.zeros(len(hashes), bool)
    if inside.any():
        at = np.flatnonzero(inside)
        value, own = three[at], doc[at]
        order = np.lexsort((value, own))
        same = (value[order][1:] == value[order][:-1]) & (own[order][1:] == own[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for k in range(3):
            again[hit + k] = True
    repeated = text.per_doc(run, again)

    dup_lines, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    feed = np.flatnonzero(run.data == 10)
    cut = np.unique(np.concatenate([run.begin, feed + 1]))
    if len(cut) > 1:
        start, stop = cut[:-1], cut[1:]
        stop = np.where(run.data[stop - 1] == 10, stop - 1, stop)
        held = np.searchsorted(run.start, stop) > np.searchsorted(run.start, start)
        start, stop = start[held], stop[held]
        own = np.searchsorted(run.begin, start, "right") - 1
        whole = Run(0, run.data, run.begin, start, stop, np.array([0, len(start)])).word_hashes()
        order = np.lexsort((whole, own))
        same = (whole[order][1:] == whole[order][:-1]) & (own[order][1:] == own[order][:-1])
        dup_lines = np.bincount(own[order][1:][same], minlength=n)
        lines = np.bincount(own, minlength=n)
    long_words = text.per_doc(run, (run.end - run.start) > 14)
    some, line = np.maximum(size, 1), np.maximum(lines, 1)
    letters = np.maximum(chars, 1)
    upper, digit, punct, bang, pipe, other = by_kind
    features = [np.log1p(size), chars / some, symbols / letters, dup_lines / line, repeated / some, upper / letters, digit / letters, punct / letters, bang / some, pipe / some, per / some, size / line, top / some, long_words / some, other / letters]
    del distinct
    return np.stack([size, chars, symbols, dup_lines, repeated], 1).astype(np.int64).reshape(n, 5), np.stack(features, 1).astype(np.float32).reshape(n, len(FEATURES))


@dataclass
class Trees:
    """feature, cut, left, right, value: one row a tree, one column a node; a leaf leads to itself."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            goes = x[rows, self.feature[tree, node]] <= self.cut[tree, node]
            node = np.where(goes, self.left[tree, node], self.right[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Boosted trees for labels y (0 or 1); without rows of both labels, only a constant."""
    width = 2 ** (DEPTH + 1)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    out = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        logit = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-logit))
            grad, hess = p - y, p * (1 - p)
            tree = {"feature": np.zeros(width, np.int64), "cut": np.full(width, np.inf, np.float32), "left": np.arange(width), "right": np.arange(width), "value": np.zeros(width)}
            used = 1
            open_nodes = [(0, np.arange(len(y)), 0, -np.inf, np.inf)]
            while open_nodes:
                node, rows, depth, low, high = open_nodes.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                tree["value"][node] = RATE * np.clip(-g / (h + RIDGE), low, high)
                logit[rows] += 0  # set below, when the tree is whole
                if depth == DEPTH or h < 2 * LEAST_WEIGHT:
                    continue
                best = (1e-6, None)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(e) + 1))[:-1]
                    fits = (hs >= LEAST_WEIGHT) & (h - hs >= LEAST_WEIGHT)
                    a, b = np.clip(-gs / (hs + RIDGE), low, high), np.clip(-(g - gs) / (h - hs + RIDGE), low, high)
                    fits &= (b - a) * signs[j] >= 0
                    gain = np.where(fits, gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE), 0)
                    if gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (j, k, a[k], b[k]))
                if best[1] is None:
                    continue
                j, k, a, b = best[1]
                less = binned[rows, j] <= k
                tree["feature"][node], tree["cut"][node] = j, edges[j][k]
                tree["left"][node], tree["right"][node] = used, used + 1
                mid = (a + b) / 2
                bounds = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
                open_nodes += [(used, rows[less], depth + 1, *bounds[0]), (used + 1, rows[~less], depth + 1, *bounds[1])]
                used += 2
            one = Trees(0.0, *(tree[k][None, :] for k in out))
            odds = one.probability(x)
            logit += np.log(odds / (1 - odds))
            for k in out:
                out[k].append(tree[k])
    stacked = [np.stack(v) if v else np.zeros((0, width), np.int64) for v in out.values()]
    return Trees(base, *stacked)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the five BASE counts and features (array of float) of every row of docs.

    docs: doc_id, text; others are ignored. Null and empty texts have zero counts.
    """

    def each(batch):
        for run in text.runs(batch.column(2)):
            base, features = _counts(run)
            own = [batch.column(1)[run.first : run.first + run.size], *(pa.array(base[:, i]) for i in range(5))]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(run.size + 1) * len(FEATURES), pa.int32()), pa.array(features.ravel()))
            yield pa.record_batch([*own, flat], ["doc_id", *BASE, "features"])

    return frames.arrow_map(frames.keyed(docs), each, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<float>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees for labels.quality, from at most ``rows`` labelled documents: those of least hash of doc_id.

    The bound is on what is fitted; it holds the driver's part to some MB at any size. Null
    labels and labels of no document count for nothing; of a doc_id with several labels each counts.
    """
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = measured(texts).select("doc_id", "features").join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "quality"])
    x = np.array(found["features"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return grow(x, (found["quality"].to_numpy() > 0).astype(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judged(docs: DataFrame, trees: Trees, keep: float = KEEP) -> DataFrame:
    """measured() with quality (probability), base_failed and kept; the trees have some 60 * 32 nodes, whatever the data."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def each(batch):
        for run in text.runs(batch.column(2)):
            base, features = _counts(run)
            quality = held.value.probability(features)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            own = [batch.column(1)[run.first : run.first + run.size], *(pa.array(base[:, i]) for i in range(5))]
            yield pa.record_batch([*own, pa.array(failed), pa.array(~failed & (quality >= keep)), pa.array(quality)], ["doc_id", *BASE, "base_failed", "kept", "quality"])

    return frames.arrow_map(frames.keyed(docs), each, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, quality double")
