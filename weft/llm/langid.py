"""Language identification by interpolated Kneser-Ney character models.

Texts are seen as lower-cased letters with one space for whatever stands between runs of
letters. For each language a model of order ``ORDER`` is fitted to a bounded number of
documents; its n-gram counts are made by a Spark aggregation. The models share one sorted
array of n-gram hashes an order, with one column of log probabilities a language (fully
interpolated), and one of context hashes with the weights of backing off. A text gets the
language of least cross-entropy a character; how sure that is, and from which
cross-entropy on a text is in none of the languages, is calibrated on documents that the
counts leave out.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import frames, text

ORDER = 4
#: Documents of a language that a model is fitted to, at most (those of least hash), and every how many-th is left for calibration.
FIT_DOCS, CALIBRATE = 800, 4
#: What is taken off each count, and the characters that a text may have at least (twice those met, if these are more).
DISCOUNT, ALPHABET = 0.75, 5000
#: Nats a character above nearly all known documents of the language, from which on a text is rejected.
MARGIN, TAIL = 1.5, 0.999
NONE = "und"

#: Whether a code point is a letter (category L).
_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def characters(line: str | None) -> np.ndarray:
    """The code points that a model sees: a space before each run of letters and one at the end; none without letters."""
    points = np.frombuffer((line or "").lower().encode("utf-32-le"), np.uint32)
    letter = np.append(_LETTER[points], False)
    after = np.append(False, letter[:-1])
    if not letter.any():
        return np.zeros(0, np.uint64)
    spaced = np.where(letter, np.append(points, 32), 32)[letter | after]  # of what stands between letters, the first place
    return np.append(32, spaced).astype(np.uint64)


def _hashes(points: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER, the hash of the n characters that end at each place (of the first places: of what there is)."""
    one = text.mix(points + np.uint64(1))
    out = [one]
    for _ in range(1, ORDER):
        longer = out[-1].copy()
        longer[1:] = one[1:] + _MULTIPLY * text.mix(out[-1][:-1])
        out.append(longer)
    return out


@dataclass
class Models:
    """languages; for each order its sorted n-gram hashes and log probabilities, and contexts and log backing-off weights; the rest calibrates."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    unseen: np.ndarray
    sharpness: float = 1.0
    limit: np.ndarray | None = None

    def entropies(self, lines: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and the nats a character of each text (rows) in each language; 0 without letters."""
        parts = [characters(x) for x in lines]
        size = np.array([max(len(p) - 1, 0) for p in parts])
        total = np.zeros((len(lines), len(self.languages)))
        some = np.flatnonzero(size)
        if len(some):
            flat = np.concatenate([parts[i] for i in some])
            start = np.append(0, np.cumsum(size[some] + 1))[:-1]
            hashes = _hashes(flat)
            place = np.arange(len(flat)) - np.repeat(start, size[some] + 1)
            at = np.flatnonzero(place > 0)  # the first space is given
            place = np.minimum(place[at], ORDER - 1)
            values = np.zeros((len(at), len(self.languages)), np.float32)
            for n in range(ORDER, 1, -1):
                pick = place >= n - 1
                own = at[pick]
                found, where = _find(self.grams[n - 1], hashes[n - 1][own])
                rows = np.flatnonzero(pick)
                values[rows[found]] += self.logs[n - 1][where[found]]
                left, rows = own[~found], rows[~found]
                known, where = _find(self.contexts[n - 1], hashes[n - 2][left - 1])
                values[rows[known]] += self.backs[n - 1][where[known]]
                place[rows] = n - 2
                place[np.flatnonzero(pick)[found]] = -1
            rows = np.flatnonzero(place >= 0)
            found, where = _find(self.grams[0], hashes[0][at[rows]])
            values[rows[found]] += self.logs[0][where[found]]
            values[rows[~found]] += self.unseen
            first = np.append(0, np.cumsum(size[some]))[:-1]
            total[some] = -np.add.reduceat(values.astype(np.float64), first, axis=0)
        return size, total / np.maximum(size, 1)[:, None]

    def predict(self, lines: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        size, nats = self.entropies(lines)
        if not self.languages:
            return [NONE] * len(lines), np.zeros(len(lines)), np.ones(len(lines), bool)
        best = nats.argmin(1)
        ratio = np.exp(-self.sharpness * np.sqrt(size)[:, None] * (nats - nats.min(1, keepdims=True)))
        score = np.where(size > 0, 1 / ratio.sum(1), 0.0)
        far = nats[np.arange(len(lines)), best] > (self.limit[best] if self.limit is not None else np.inf)
        return [self.languages[b] if n else NONE for b, n in zip(best, size, strict=True)], score, far | (size == 0)


def _find(array: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(array):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    where = np.minimum(np.searchsorted(array, values), len(array) - 1)
    return array[where] == values, where


def _kneser_ney(counts: dict[str, np.ndarray], languages: list[str]) -> Models:
    """counts: language (its index), order, gram, context, suffix (hashes), n."""
    of_order = {n: {c: x[counts["order"] == n] for c, x in counts.items()} for n in range(1, ORDER + 1)}
    width = len(languages)
    grams, logs, contexts, backs = [], [], [], []
    lower = floor = None
    for order in range(1, ORDER + 1):
        own = of_order[order]
        names, first = np.unique(own["gram"], return_index=True)
        context, suffix = own["context"][first], own["suffix"][first]
        if order < ORDER:  # how many characters come before
            higher = of_order[order + 1]
            value, lang, n = higher["suffix"], higher["language"], np.ones(len(higher["suffix"]))
        else:
            value, lang, n = own["gram"], own["language"], own["n"].astype(float)
        table = np.zeros((len(names), width))
        found, where = _find(names, value)
        np.add.at(table, (where[found], lang[found]), n[found])
        heads = np.unique(context)
        _, head = _find(heads, context)
        total, kinds = np.zeros((len(heads), width)), np.zeros((len(heads), width))
        np.add.at(total, head, table)
        np.add.at(kinds, head, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            direct = np.where(total[head] > 0, np.maximum(table - DISCOUNT, 0) / np.maximum(total[head], 1), 0)
        if order == 1:
            alphabet = max(ALPHABET, 2 * len(names))
            floor = back[0] / alphabet if len(heads) else np.full(width, 1 / alphabet)
            base = np.broadcast_to(floor, table.shape)
        else:
            ok, where = _find(grams[-1], suffix)
            base = back[head] * np.where(ok[:, None], lower[where] if len(lower) else 0, floor)
        lower = direct + base
        grams.append(names)
        logs.append(np.log(np.maximum(lower, 1e-12)).astype(np.float32))
        contexts.append(heads)
        backs.append(np.log(back).astype(np.float32))
    return Models(languages, grams, logs, contexts, backs, np.log(floor).astype(np.float32))


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from all learning; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Models:
    """Models of each value of lang, from documents that are not held out (doc_id, text, lang; others are ignored).

    Of each language the ``fit_docs`` documents of least hash are read, whole; the bound
    is on what is fitted. Null or empty languages and texts without letters teach nothing; a row
    that is there several times may be read as often. Of an empty table there is no language.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}") & (F.col("lang") != ""))
    draw = F.xxhash64("doc_id", "text")
    share = {r["lang"]: 4 * fit_docs / r["count"] for r in known.groupBy("lang").count().collect()}
    # Only rows whose hash makes them likely to be among the least go to the ranking.
    limits = F.create_map(*(F.lit(x) for name, part in share.items() for x in (name, min(part, 1.0)))) if share else F.create_map().cast("map<string,double>")
    likely = known.where(draw.cast("double") <= (2 * F.element_at(limits, F.col("lang")) - 1) * 2.0**63)
    order = Window.partitionBy("lang").orderBy(draw)
    chosen = frames.stored(likely.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fit_docs).select("text", "lang", "rank"))
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    index = {name: i for i, name in enumerate(languages)}

    def count(batch):
        for i in range(batch.num_rows):
            points = characters(batch.column(0)[i].as_py())
            if len(points) < 2:
                continue
            hashes = _hashes(points)
            for n in range(1, ORDER + 1):
                at = np.arange(max(n - 1, 1), len(points))
                gram, first, count = np.unique(hashes[n - 1][at], return_index=True, return_counts=True)
                at = at[first]
                context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
                suffix = hashes[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
                yield pa.record_batch([pa.array(np.full(len(at), index[batch.column(1)[i].as_py()])), pa.array(np.full(len(at), n)), *(pa.array(text.signed(x)) for x in (gram, context, suffix)), pa.array(count)], ["language", "order", "gram", "context", "suffix", "n"])

    raw = frames.arrow_map(chosen.where(F.col("rank") % CALIBRATE != 0).select("text", "lang"), count, "language long, order long, gram long, context long, suffix long, n long")
    summed = raw.groupBy("language", "order", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("n").alias("n")).toArrow()
    counts = {c: summed.column(c).to_numpy() for c in summed.column_names}
    models = _kneser_ney(counts | {c: text.unsigned(counts[c]) for c in ("gram", "context", "suffix")}, languages)
    return _calibrated(models, chosen.where(F.col("rank") % CALIBRATE == 0).select("text", "lang"))


def _slices(lines: list[str | None], most: int = 400_000):
    """Ranges of lines of so many characters together, or of one line."""
    at = 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or size + len(lines[to] or "") <= most):
            size += len(lines[to] or "")
            to += 1
        yield at, to
        at = to


def _calibrated(models: Models, known: DataFrame) -> Models:
    """models with sharpness and limits from texts of known languages that it was not fitted to; only their entropies come to the driver."""
    models.limit = np.full(len(models.languages), np.inf)
    held = known.sparkSession.sparkContext.broadcast(models)

    def each(batch):
        lines = batch.column(0).to_pylist()
        for at, to in _slices(lines):
            size, nats = held.value.entropies(lines[at:to])
            yield pa.record_batch([batch.column(1)[at:to], pa.array(size), pa.array(list(nats), pa.list_(pa.float64()))], ["lang", "size", "nats"])

    rows = sorted(map(tuple, frames.arrow_map(known, each, "lang string, size long, nats array<double>").collect())) if models.languages else []
    held.destroy()
    if not rows:
        return models
    size, nats = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    truth = np.array([models.languages.index(r[0]) for r in rows])
    own = nats[np.arange(len(truth)), truth]
    for i in range(len(models.languages)):
        if (truth == i).any():
            models.limit[i] = np.quantile(own[truth == i], TAIL) + MARGIN
    gap = np.sqrt(size)[:, None] * (nats - nats.min(1, keepdims=True))
    loss = {}
    for s in np.geomspace(0.05, 20, 25):
        ratio = np.exp(-s * gap)
        loss[s] = -np.log(np.maximum(ratio[np.arange(len(truth)), truth] / ratio.sum(1), 1e-6)).mean()
    models.sharpness = float(min(loss, key=loss.get))
    return models


def predicted(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs (doc_id, text; others are ignored).

    A null, empty or letterless text is ``und``, with score 0, and rejected. A text that is
    further from its language than nearly all known ones is rejected but keeps its guess.
    The models' size is bounded by what they were fitted to.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)

    def each(batch):
        lines = batch.column(1).to_pylist()
        for at, to in _slices(lines):
            names, score, far = held.value.predict(lines[at:to])
            yield pa.record_batch([batch.column(0)[at:to], batch.column(2)[at:to], pa.array(names, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    return frames.arrow_map(source, each, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs, with all columns, that are not rejected; see predicted()."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    text_at = docs.columns.index("text")

    def each(batch):
        lines = batch.column(text_at).to_pylist()
        stay = []
        for at, to in _slices(lines):
            stay += (~held.value.predict(lines[at:to])[2]).tolist()
        yield batch.filter(pa.array(stay, pa.bool_()))

    return frames.arrow_map(docs, each, docs.schema)
