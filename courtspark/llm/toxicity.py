"""Toxicity classifier, regularised by counterfactuals.

A logistic model over the words of a text and the starts of its words (inflected abuse shares its
start), hashed into a table of fixed size, with an L1 penalty that leaves few of them with a weight. In every labelled sentence that names a group, the name
is swapped for each other name of its kind and for a neutral word; the squared change of the score
(its log-odds) is added to the loss. Names of groups, which often stand in abusive sentences, then
cannot carry a score of their own, and neutral mentions stay below the threshold.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hashes of their
ids; all rows are scored over their whole texts. Spark counts the texts of every word and the swaps of
every pair of names; of the texts only words that may get a weight reach the driver.

Defined cases: a null or empty text has no words and gets the score of the intercept; null labels
are left out; without rows of both labels every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import row_hash, small_batches, stage
from courtspark.llm.quality import bounded_labels, held_out

THRESHOLD = 0.7
MAX_ROWS = 20_000
#: Size of the word table; what is in fewer labelled texts than MIN_TEXTS gets no weight.
SLOTS, MIN_TEXTS = 1 << 20, 8
L1, COUNTERFACTUAL, ROUNDS = 2e-5, 10.0, 600
#: Only words whose share of toxic texts is so many standard errors from the mean are looked at.
APART = 5
STARTS = (4, 5)

# Names of groups by kind, each with a neutral word at the end.
GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "people"),
    ("woman", "man", "transgender", "person"),
    ("women", "men", "people"),
    ("gay", "lesbian", "straight", "queer", "bisexual", "single"),
    ("black", "white", "asian", "latino", "african", "arab", "young"),
    ("immigrants", "refugees", "foreigners", "citizens", "people"),
    ("frauen", "männer", "menschen"),
    ("muslime", "christen", "juden", "menschen"),
    ("femmes", "hommes", "gens"),
    ("musulmans", "chrétiens", "juifs", "gens"),
    ("mujeres", "hombres", "personas"),
    ("musulmanes", "cristianos", "judíos", "personas"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def slot(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % SLOTS


_NAMES = frozenset(chain.from_iterable(GROUPS))
_PARTNERS = {a: [b for b in group if b != a] for group in GROUPS for a in group[:-1]}


def swaps(text: str) -> list[tuple[int, int]]:
    """Slots of (name, other name) for every swap in every sentence."""
    low = text.lower()
    if not any(a in low for a in _PARTNERS):
        return []
    return [(slot(a), slot(b)) for part in _SENTENCE.split(low) for a in set(_WORD.findall(part)) & _PARTNERS.keys() for b in _PARTNERS[a]]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """The words, and the starts of longer ones, marked with a hyphen; names of groups have no starts,
    so that a swap changes all that they add to a score."""
    others = words - _NAMES
    return words.union(*({w[:k] + "-" for w in others if len(w) > k} for k in STARTS))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -60, 60)))


def train(rows: list[np.ndarray], labels: np.ndarray, changed: np.ndarray, often: np.ndarray | None = None) -> Model:
    """``rows``: slots of each text's words; ``changed``: pairs of slots that were swapped, each as ``often``
    (once)."""
    weights, y = np.zeros(SLOTS), np.asarray(labels, float)
    n = len(y)
    if not 0 < y.sum() < n:
        share = y.mean() if n else 0.5
        return Model(float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / (1 - np.clip(share, 1e-9, 1 - 1e-9)))), weights)
    slots = np.concatenate(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    times = np.bincount(slots, minlength=SLOTS)
    in_toxic = np.bincount(slots, weights=y[row], minlength=SLOTS)
    # words whose share of toxic texts may differ from the mean; the others would get no weight
    mean = y.mean()
    z = (in_toxic - times * mean) / np.sqrt(np.maximum(times, 1) * mean * (1 - mean))
    used = np.union1d(np.flatnonzero((times >= MIN_TEXTS) & (np.abs(z) > APART)), np.unique(changed))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    keep = place[slots] >= 0
    col, row = place[slots[keep]], row[keep]
    pairs, at = np.unique(place[changed], axis=0, return_inverse=True) if len(changed) else (np.zeros((0, 2), int), np.zeros(0, int))
    counts = np.bincount(at.ravel(), often, minlength=len(pairs))
    pull = 2 * COUNTERFACTUAL * counts / n
    weigh = np.where(y > 0, 0.5 / mean, 0.5 / (1 - mean)) / n  # both labels count alike
    # steps by coordinate, from a bound of the second derivative that adds up over the words of a row
    width = np.bincount(row, minlength=n) + 1.0
    bend = np.bincount(col, (width * weigh)[row], minlength=len(used)) * 0.25
    bend += 2 * np.bincount(pairs.ravel(), np.repeat(pull, 2), minlength=len(used)) + 1e-12
    step, step_b = 1 / bend, 4 / (width * weigh).sum()
    w = v = np.zeros(len(used))
    b = c = 0.0
    t = 1.0
    for _ in range(ROUNDS):
        odds = c + np.bincount(row, v[col], minlength=n)
        off = (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - y) * weigh
        grad = np.bincount(col, off[row], minlength=len(used))
        gap = pull * (v[pairs[:, 0]] - v[pairs[:, 1]])
        np.add.at(grad, pairs[:, 0], gap)
        np.subtract.at(grad, pairs[:, 1], gap)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = c - step_b * off.sum()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new, new_b
    weights[used] = w
    return Model(float(b), weights)


def _rows(batches):
    """Slots of the words and the swaps of labelled texts; a swap is one number."""
    for batch in batches:
        slots, pairs = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            slots.append(np.array([slot(w) for w in features(words_of(text))], np.int32))
            pairs.append(np.array([a * SLOTS + b for a, b in swaps(text)], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(slots, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.int64()))], names=["label", "slots", "pairs"])


def _apart(rows: DataFrame, mean: float) -> np.ndarray:
    """Slots that ``train`` looks at for their share of toxic texts."""
    counts = rows.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("times"), F.sum("label").alias("toxic"))
    z = (F.col("toxic") - F.col("times") * mean) / F.sqrt(F.col("times") * mean * (1 - mean))
    return np.asarray(counts.where((F.col("times") >= MIN_TEXTS) & (F.abs(z) > APART)).select("slot").toArrow().column("slot"))


def _only(used: np.ndarray):
    """Slots of each text without those that are not ``used``."""

    def run(batches):
        wanted = np.zeros(SLOTS, bool)
        wanted[used] = True
        for batch in batches:
            slots = [x.values.to_numpy() for x in batch.column("slots")]
            kept = pa.array([x[wanted[x]].tobytes() for x in slots], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), kept], names=["row", "label", "slots"])

    return run


def fit(texts: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """``labels`` has doc_id and label (0 or 1); ``texts`` has doc_id and text."""
    rows = texts.select("doc_id", "text").join(bounded_labels(labels, max_rows, "toxicity"), "doc_id").select("label", "text")
    rows = rows.mapInArrow(_rows, "label long, slots array<int>, pairs array<long>")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "words")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return train([np.zeros(0, np.int32)] * n, np.repeat([1, 0], [toxic, n - toxic]), np.zeros((0, 2), int))
    swapped = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").count().toArrow()  # at most the pairs of GROUPS
    pair, often = (np.asarray(swapped.column(c)) for c in ("pair", "count"))
    changed = np.c_[pair // SLOTS, pair % SLOTS]
    used = np.union1d(_apart(rows, toxic / n), changed).astype(np.int64)
    got = rows.mapInArrow(_only(used), "row long, label long, slots binary").toArrow()  # at most max_rows rows of the words in use
    got = got.sort_by("row")  # sums then round alike, in whatever order the written rows are read
    return train([np.frombuffer(x.as_buffer(), np.int32) for x in got.column("slots")], np.asarray(got.column("label")), changed, often)


class _Weights(dict):
    """Weight of a word with its starts, emptied when it gets large."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.table = weights

    def __missing__(self, feature: str) -> float:
        if len(self) > 1 << 19:
            self.clear()
        self[feature] = value = float(self.table[slot(feature)])
        return value


def _scorer(model: Model):
    """A function of texts; at most SLOTS weights travel with the tasks."""
    bias, at = model.bias, np.flatnonzero(model.weights)
    values = model.weights[at]

    def start():
        table = np.zeros(SLOTS)
        table[at] = values
        here, weights = Model(bias, table), _Weights(table)
        return lambda texts: here.score(np.array([sum(map(weights.__getitem__, features(words_of(t.as_py())))) for t in texts], float))

    return start


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> Model:
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).where(~held_out(F.col("doc_id"), 3, 1))
    return fit(texts, known, max_rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, row_hash, held_out, score (0 to 1), predicted."""
    start = _scorer(learned(docs, labels, id_col, text_col, label_col, max_rows))

    def run(batches):
        score = start()
        for batch in batches:
            got = pa.array(score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), got], names=["doc_id", "row_hash", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.select("doc_id", row_hash(F.col("text")).alias("row_hash"), "text")
    out = rows.mapInArrow(run, "doc_id long, row_hash long, score double")
    return out.select("doc_id", "row_hash", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below the threshold."""
    start = _scorer(learned(docs, labels, id_col, text_col, label_col, max_rows))

    def run(batches):
        score = start()
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(text_col)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
