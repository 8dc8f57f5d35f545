"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over the statistics of whole texts. Its covariance is shrunk towards the
diagonal of its own variances and, a little, towards the pooled covariance, so that rare classes and
nearly constant statistics stay invertible. The score is the logistic of the log-prior and
log-density difference; densities come from Mahalanobis lengths by triangular solves with Cholesky
factors that are computed once. Class moments are taken from at most ``max_rows`` labelled rows, added
up per task and then over tasks: nothing but two matrices of fixed size reaches the driver. All rows
are scored.

Defined cases: a null or empty text has all counts 0 and is scored as such; null labels are left
out; without rows of both labels every score is the share of label 1 (0.5 without labels); a
document labelled more than once counts once for each label row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import row_hash, small_batches, stage

STATISTICS = (
    "words", "word_length", "letters", "upper", "symbols", "digits", "marks", "distinct", "repeats",
    "pairs", "short", "sentences", "shouts", "lines", "equal_lines", "long_words",
)
THRESHOLD = 0.7
#: Labelled rows that the moments are taken from at most.
MAX_ROWS = 20_000
#: Shrinkage of a class covariance towards its own diagonal, and towards the pooled covariance.
TO_DIAGONAL, TO_POOLED = 0.1, 0.05
#: Weight, in words or characters, of the usual share of prose in each statistic: short texts look usual.
WEIGHT = 12.0
_SPACE, _LETTER, _UPPER, _DIGIT, _MARK, _SHOUT, _SYMBOL = range(7)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane; those beyond count as symbols."""

    def kind(c: str) -> int:
        if c.isspace():
            return _SPACE
        if c.isalpha():
            return _UPPER if c.isupper() else _LETTER
        if c.isdigit():
            return _DIGIT
        return _MARK if c in ".,;:'-" else _SHOUT if c == "!" else _SYMBOL

    return np.array([*map(kind, map(chr, range(0x10000))), _SYMBOL], np.uint8)


def _share(k: float, n: float, usual: float) -> float:
    """Log-odds of k out of n, smoothed towards the usual share."""
    return float(np.log((k + WEIGHT * usual) / (max(n - k, 0) + WEIGHT * (1 - usual))))


def _ratio(k: float, n: float, usual: float) -> float:
    return float(np.log((k + WEIGHT * usual) / (n + WEIGHT)))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    kinds = _kinds()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)]
    count = np.bincount(kinds, minlength=7)
    letter = np.r_[False, (kinds == _LETTER) | (kinds == _UPPER), False]
    runs = np.diff(np.flatnonzero(letter[1:] != letter[:-1]))[::2]
    words = text.split()
    n, chars = len(words), int(len(kinds) - count[_SPACE])
    letters = int(count[_LETTER] + count[_UPPER])
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)),
        _ratio(chars, n, 5.5),
        _share(letters, chars, 0.95),
        _share(count[_UPPER], letters, 0.03),
        _share(count[_SYMBOL], chars, 0.005),
        _share(count[_DIGIT], chars, 0.01),
        _share(count[_MARK], chars, 0.03),
        _ratio(len(set(words)), n, 0.9),
        _share(sum(map(eq, words, words[1:])), n, 0.01),
        _ratio(len(set(zip(words, words[1:], strict=False))), n, 0.97),
        _share(int((runs < 4).sum()), len(runs), 0.35),
        _share(sum(w.endswith((".", "?")) for w in words), n, 0.1),
        _share(count[_SHOUT], n, 0.005),
        _ratio(len(lines), n, 0.02),
        _share(len(lines) - len(set(lines)), len(lines), 0.02),
        _share(sum(len(w) > 20 for w in words), n, 0.01),
    ]


def _matrix(texts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], float).reshape(len(texts), len(STATISTICS))


def _moments(batches):
    """Per task and label: rows, sums and products of (1, x)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch.column("text")), np.asarray(batch.column("label"))
            x = np.c_[np.ones(len(x)), x]
            for label in np.unique(y):
                part = x[y == label]
                sums[int(label)] = sums.get(int(label), 0) + part.T @ part
    labels = [k for k in sums for _ in range(sums[k].size)]
    at = [i for k in sums for i in range(sums[k].size)]
    values = [v for k in sums for v in sums[k].ravel()]
    yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(at, pa.int64()), pa.array(values, pa.float64())], names=["label", "at", "value"])


@dataclass(frozen=True)
class Discriminant:
    """Priors, means, inverse Cholesky factors and log-determinants of both classes."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * ((z * z).sum(1) + logdet))
        odds = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit_moments(moments: dict[int, np.ndarray], to_diagonal: float = TO_DIAGONAL, to_pooled: float = TO_POOLED) -> Discriminant:
    n = {k: float(moments[k][0, 0]) if k in moments else 0.0 for k in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant(n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    means = {k: moments[k][0, 1:] / n[k] for k in (0, 1)}
    scatter = {k: moments[k][1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)}
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    factors, logdets = [], []
    for k in (0, 1):
        own = scatter[k] / n[k]
        mixed = (1 - to_diagonal - to_pooled) * own + to_diagonal * np.diag(np.diag(own)) + to_pooled * pooled
        lower = np.linalg.cholesky(mixed + 1e-6 * np.eye(len(mixed)))
        factors.append(np.linalg.solve(lower, np.eye(len(lower))))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(n[1] / (n[0] + n[1]), np.array([means[0], means[1]]), np.array(factors), np.array(logdets))


def bounded_labels(labels: DataFrame, max_rows: int, salt: str) -> DataFrame:
    """At most ``max_rows`` rows of doc_id and label (0 or 1): those with the smallest hashes."""
    rows = labels.where("label IN (0, 1) AND doc_id IS NOT NULL")
    rows = rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(salt)), "doc_id", "label").limit(max_rows)
    return stage(rows.select("doc_id", F.col("label").cast("long").alias("label")), "labels")


def fit(texts: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Discriminant:
    """``texts`` has doc_id and text, ``labels`` has doc_id and label."""
    rows = texts.select("doc_id", "text").join(bounded_labels(labels, max_rows, "quality"), "doc_id").select("label", "text")
    sums = rows.mapInArrow(_moments, "label long, at long, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    got = sums.toPandas()  # two matrices of fixed size
    size = len(STATISTICS) + 1
    return fit_moments({int(k): p.sort_values("at")["value"].to_numpy().reshape(size, size) for k, p in got.groupby("label")})


def held_out(doc_id, parts: int, part: int):
    """Rows kept from learning, by the checksum of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> Discriminant:
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).where(~held_out(F.col("doc_id"), 4, 2))
    return fit(texts, known, max_rows)


def _scored(model: Discriminant):
    def run(batches):
        for batch in batches:
            score = pa.array(model.score(_matrix(batch.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), score], names=["doc_id", "row_hash", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, row_hash, held_out, score (0 to 1), predicted."""
    model = learned(docs, labels, id_col, text_col, label_col, max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.select("doc_id", row_hash(F.col("text")).alias("row_hash"), "text")
    out = rows.mapInArrow(_scored(model), "doc_id long, row_hash long, score double")
    return out.select("doc_id", "row_hash", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    model = learned(docs, labels, id_col, text_col, label_col, max_rows)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(_matrix(batch.column(text_col))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
