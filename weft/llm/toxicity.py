"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insults (strong or weak, learned from labels), threats, targets,
negations and verbs of reported speech. A clause, the words between two marks like ``.``
or ``;``, is read by a composition of transducers: one turns insults and threats in the
scope of a negation into denied ones, one those after reported speech into quoted ones,
and one those next to a target into attacks. The weights of what comes out are fitted to
labels, so a text's score is that of its matched clauses, not of lone words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import frames
from weft.llm.langid import held_out

#: Labelled documents (those of least hash) that lexicon and weights are fitted to, at most.
FIT_ROWS = 20_000
#: Share of toxic documents among those with an entry, for a strong and a weak insult; toxic documents with it at least; letters of stems.
STRONG, WEAK, SUPPORT, STEMS = 0.95, 0.8, 6, (3, 4, 5, 6, 7, 8)
CUTOFF = 0.3

# Function words of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy murder attack burn beat shoot töten verletzen schlagen tuer frapper détruire matar golpear destruir"
TARGETS = "you your yourself they them he she du dich dir ihr euch sie tu toi vous ils eux tú ti usted ellos"
NEGATIONS = "not no never nobody isn aren nicht kein keine niemals pas jamais aucun nunca tampoco"
REPORTS = "said says wrote quoted called claimed reported sagte schrieb nannte dit écrit appelé dijo escribió llamó"

OTHER, STRONG_INSULT, WEAK_INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(8)
_INPUT = range(7)
#: What a clause gives: plain, denied, quoted and attacking insults, weak ones, plain and directed threats.
OUTPUTS = ("insult", "denied", "quoted", "attack", "weak", "threat", "directed")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """start, and for each state and symbol the next state and what is written."""

    start: object
    step: Callable[[object, object], tuple[object, object]]


def compose(first: Transducer, then: Transducer) -> Transducer:
    """Reads with ``first`` and passes what it writes to ``then``."""

    def step(state, symbol):
        one, middle = first.step(state[0], symbol)
        two, out = then.step(state[1], middle)
        return (one, two), out

    return Transducer((first.start, then.start), step)


def _negate(left, symbol):
    """An insult or threat within three words after a negation is denied."""
    if symbol == NEGATION:
        return 3, symbol
    if left and symbol in (STRONG_INSULT, WEAK_INSULT, THREAT):
        return left - 1, "denied"
    return max(left - 1, 0), symbol


def _quote(within, symbol):
    """After a verb of reported speech, what the rest of the clause holds is quoted."""
    if symbol == REPORT:
        return True, symbol
    return within, "quoted" if within and symbol in (STRONG_INSULT, WEAK_INSULT, THREAT) else symbol


def _aim(left, symbol):
    """An insult or threat within two words after a target is an attack; so is one that a target follows."""
    near, struck = left
    if symbol == TARGET:
        return (2, 0), {STRONG_INSULT: "attack", WEAK_INSULT: "attack", THREAT: "directed"}.get(struck)
    plain = {STRONG_INSULT: "insult", WEAK_INSULT: "weak", THREAT: "threat"}.get(symbol)
    if plain is None:
        return (max(near - 1, 0), 0), symbol if isinstance(symbol, str) else None
    aimed = {"insult": "attack", "weak": "attack", "threat": "directed"}[plain]
    return (max(near - 1, 0), symbol), aimed if near else plain


def machine(grammar: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """The transducer as tables: next state and output (or -1) by state and input class."""
    states, table = {grammar.start: 0}, []
    todo = [grammar.start]
    for state in todo:
        row = []
        for symbol in _INPUT:
            to, out = grammar.step(state, symbol)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append((states[to], OUTPUTS.index(out) if out in OUTPUTS else -1))
        table.append(row)
    whole = np.array(table)
    return whole[..., 0], whole[..., 1]


GRAMMAR = compose(compose(Transducer(0, _negate), Transducer(False, _quote)), Transducer((0, 0), _aim))


class _Classes(dict):
    """The class of each word met, up to a number of words."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.stems = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.fixed = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for word in words.split():
                self.fixed.setdefault(word, kind)
        self.fixed |= dict.fromkeys(".!?;:\n", END)

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        kind = self.fixed.get(word)
        if kind is None:
            kind = next((self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems), OTHER)
        self[word] = kind
        return kind


class Matcher:
    def __init__(self, lexicon: dict[str, int]):
        self.classes = _Classes(lexicon)
        after, out = machine(GRAMMAR)
        self.after, self.out = after.tolist(), out.tolist()

    def counts(self, line: str | None) -> list[int]:
        """How often each of OUTPUTS comes out of a text."""
        found = [0] * len(OUTPUTS)
        kinds = bytes(map(self.classes.__getitem__, _TOKEN.findall((line or "").lower())))
        if kinds.find(STRONG_INSULT) < 0 and kinds.find(WEAK_INSULT) < 0 and kinds.find(THREAT) < 0:
            return found
        for clause in kinds.split(bytes([END])):
            if STRONG_INSULT in clause or WEAK_INSULT in clause or THREAT in clause:
                state = 0
                for kind in clause:
                    out = self.out[state][kind]
                    state = self.after[state][kind]
                    if out >= 0:
                        found[out] += 1
        return found


@dataclass
class Model:
    lexicon: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(counts) @ self.weights + self.bias)))


def _counted(texts: DataFrame, lexicon: dict[str, int], keep: list[str]) -> DataFrame:
    """keep columns of texts and counts, an array of the OUTPUTS of column text."""

    def over(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, frames.ROWS):
                part = batch.slice(at, frames.ROWS)
                rows = [matcher.counts(t) for t in part.column(0).to_pylist()]
                yield pa.record_batch([*part.columns[1:], pa.array(rows, pa.list_(pa.int64()))], [*keep, "counts"])

    kinds = dict(texts.dtypes)
    return texts.select("text", *keep).mapInArrow(over, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", counts array<long>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The lexicon and weights, from labels.toxic of documents that are not held out.

    At most ``rows`` labelled documents are used, those of least hash of doc_id; the bound
    is on what is fitted. Null labels, ids and texts teach nothing; a row that is there several
    times counts as often. Without a label of either kind, as in empty tables, the lexicon is
    empty and every score small.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = frames.stored(texts.select("text", "toxic"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    stems = [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    terms = texts.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
    odds = terms.groupBy("term").agg(F.sum("toxic").alias("hit"), F.count("*").alias("n"))
    found = odds.where((F.col("hit") >= SUPPORT) & (F.col("hit") >= WEAK * F.col("n"))).collect()
    lexicon = {r["term"]: STRONG_INSULT if r["hit"] >= STRONG * r["n"] else WEAK_INSULT for r in found}
    for term in sorted(lexicon, key=len, reverse=True):  # a stem covers its longer ones
        body = term.rstrip("*")
        if any(f"{body[:n]}*" in lexicon and len(body) > n and lexicon[f"{body[:n]}*"] <= lexicon[term] for n in STEMS):
            del lexicon[term]
    seen = _counted(texts, lexicon, ["toxic"]).groupBy("counts", "toxic").count().toPandas()
    seen = seen.assign(by=seen["counts"].map(tuple)).sort_values(["by", "toxic"])
    x = np.log1p(np.array(seen["counts"].tolist(), float).reshape(-1, len(OUTPUTS)))
    return Model(lexicon, *_logistic(x, seen["toxic"].to_numpy(float), seen["count"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on rows that stand for n documents each, by Newton steps."""
    full = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(full.shape[1])
    beta[-1] = -4.0
    penalty = np.append(np.full(x.shape[1], ridge), 0.01)
    start = beta.copy()

    def loss(at):
        z = full @ at
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (penalty * (at - start) ** 2).sum() / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -500, 500)))
        grad = full.T @ (n * (p - y)) + penalty * (beta - start)
        step = np.linalg.solve((full * (n * p * (1 - p))[:, None]).T @ full + np.diag(penalty), grad)
        size, now = 1.0, loss(beta)
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
    return beta[:-1], float(beta[-1])


def scored(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted and counts (of OUTPUTS) of every row of docs (doc_id, text; others are ignored).

    A null or empty text has no clause and so the least evidence; a text of any length is read
    whole. Repeated rows are scored each; an empty table gives an empty result. The model's size
    is bounded by what it was fitted to.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("held_out", held_out(F.col("doc_id")))
    logit = sum((F.log1p(F.col("counts")[i]) * float(w) for i, w in enumerate(model.weights)), F.lit(model.bias))
    out = _counted(texts, model.lexicon, ["doc_id", "held_out"]).withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "counts")
