"""Languages of a document: a mixture over n-gram models, its parts chosen by penalised likelihood.

Every learned language is a distribution over hashed n-grams of one to three letters, lower-cased, with
one space for whatever stands between letters. A document is a bag of n-grams, each drawn from one of its
languages; expectation-maximisation estimates the proportions. The log-likelihood is concave in the
proportions, so at proportions that are best for a set of languages, no mixture whatever gains more than
``max_l sum_g count_g p_l(g) / p(g) - n``. The set starts with the likeliest single language. While that
bound is over the penalty of one more language, the addition that gains most is made if its gain is over
the penalty; then languages whose loss costs less than the penalty are dropped. Most documents are done at the
first bound, without any iteration.

The models come from about ``per_language`` labelled rows of each language at most (all, if fewer), chosen
by a hash of id and text; n-grams are added up per task, then over tasks, and a table of ``SLOTS`` counts for
each language reaches the driver. Whole texts are predicted, in pieces of ``PIECE`` characters.

Defined cases: a null text, or one without letters, is ``und`` with score 0, and so is every text if no
language was learned; null languages are not learned from; a null id is not held out; equal likelihoods go
to the language that comes first in the alphabet; repeated rows are predicted alike; an empty table gives an
empty table; other columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import column, stage
from courtspark.llm.quality import held_out

SLOTS = 1 << 16
#: Expected number of rows that a language is learned from at most.
PER_LANGUAGE = 5_000
#: Counts added to every slot, as a share of one n-gram.
SMOOTH = 0.1
#: Log-likelihood that one more language must gain, times the logarithm of the number of n-grams.
PENALTY = 4.0
ROUNDS, PRECISION = 200, 1e-3
#: Languages whose list may be sent to all tasks; a longer one is joined.
LISTED = 10_000
PIECE = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _slots(code: np.ndarray) -> np.ndarray:
    """Slots of all n-grams in a row of letters and spaces; those that are a single space are left out."""
    one = code[code != 32] * np.uint32(0x165667B1)
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    mixed = np.concatenate([one, two, three])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return mixed >> np.uint32(16)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots in rising order, and how often each occurs. Pieces overlap by two places, so that n-grams
    across a border are counted as well."""
    total = np.zeros(SLOTS, np.int64)
    tail = np.full(1, 32, np.uint32)
    for begin in range(0, len(text or ""), PIECE):
        code = np.frombuffer(text[begin : begin + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(_letters()[code], code, np.uint32(32))
        code = np.concatenate([tail, code, tail[:0] if begin + PIECE < len(text) else np.full(1, 32, np.uint32)])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = code[keep]
        if len(code) >= 3:
            total += np.bincount(_slots(code), minlength=SLOTS)
            if len(tail) > 1:  # the overlap's own n-grams were counted with the piece before
                total -= np.bincount(_slots(tail), minlength=SLOTS)
        tail = code[-2:]
    slots = np.flatnonzero(total)
    return slots, total[slots]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass(frozen=True)
class Languages:
    """Names in alphabetical order, and the probability of every slot under each."""

    names: list[str]
    p: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray], smooth: float = SMOOTH) -> Languages:
        names = sorted(counts)
        c = np.array([counts[n] for n in names], float).reshape(len(names), SLOTS) + smooth
        return cls(names, c / c.sum(1, keepdims=True))


def _best_shares(p: np.ndarray, count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood; ends when no mixture of these
    languages can gain more than ``PRECISION``."""
    shares, n = start, count.sum()
    for _ in range(ROUNDS):
        mixed = shares @ p
        pull = p @ (count / mixed)
        if pull.max() - n <= PRECISION:
            break
        shares = shares * pull / n
    return shares, float(count @ np.log(shares @ p))


def mixture(model: Languages, slots: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """Proportion of each language of the chosen set, by its place in ``model.names``."""
    p, n = model.p[:, slots], count.sum()
    alone = np.log(p) @ count
    chosen, shares = [int(alone.argmax())], np.ones(1)
    likelihood, price = float(alone.max()), penalty * np.log(max(n, 2))
    while len(chosen) < len(p):
        pull = p @ (count / (shares @ p[chosen]))
        if pull.max() - n <= price:
            break
        tried = []
        for k in np.flatnonzero(pull - n > 0):
            if k not in chosen:
                start = np.r_[shares * 0.5, 0.5]
                tried.append((*_best_shares(p[[*chosen, k]], count, start), int(k)))
        gain, where = max(((t[1] - likelihood, -i) for i, t in enumerate(tried)), default=(0.0, 0))
        if gain <= price:
            break
        shares, likelihood, k = tried[-where]
        chosen.append(k)
    while len(chosen) > 1:
        rest = [[k for k in chosen if k != out] for out in chosen]
        tried = [_best_shares(p[r], count, np.full(len(r), 1 / len(r))) for r in rest]
        i = max(range(len(rest)), key=lambda i: tried[i][1])
        if likelihood - tried[i][1] > price:
            break
        chosen, (shares, likelihood) = rest[i], tried[i]
    return dict(zip(chosen, shares.tolist(), strict=True))


def predict(model: Languages, text: str | None, penalty: float = PENALTY) -> tuple[str, float, list[dict]]:
    """Language with the largest share, that share, and all languages of the chosen set with theirs."""
    if not model.names or not has_letter(text):
        return UNKNOWN, 0.0, []
    found = mixture(model, *grams(text), penalty)
    parts = sorted(((-share, model.names[k]) for k, share in found.items()))
    return parts[0][1], min(1.0, -parts[0][0]), [{"lang": name, "share": -share} for share, name in parts]


def _counted(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            slots, count = grams(text.as_py())
            sums.setdefault(lang, np.zeros(SLOTS, np.int64))[slots] += count
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "slot", "n"])


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Languages:
    """Models of the languages of ``docs``, held-out rows left out."""
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    sizes = stage(rows.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share")), "languages")
    if sizes.count() <= LISTED:  # texts stay where they are
        sizes = F.broadcast(sizes)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(sizes, "lang").where(draw < F.col("share")).select("lang", "text")
    got = stage(sample.mapInArrow(_counted, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "grams").toPandas()
    counts = {}
    for lang, part in got.groupby("lang"):
        counts[lang] = np.zeros(SLOTS)
        counts[lang][part["slot"]] = part["n"]
    return Languages.of(counts)


def languages(docs: DataFrame, model: Languages | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, parts (language and share)."""
    model = model or learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names times 2^16 numbers

    def run(batches):
        for batch in batches:
            found = [predict(shared.value, t.as_py(), penalty) for t in batch.column("text")]
            lang, score, parts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "lang_pred", "score", "parts"],
            )

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, parts array<struct<lang:string,share:double>>")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "parts")
