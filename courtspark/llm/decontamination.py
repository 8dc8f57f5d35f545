"""Benchmark decontamination by winnowed fingerprints, in Spark's own functions only.

A *window* is ``span`` consecutive words of a benchmark item; a shorter item is one window. Every
document word that lies in an occurrence of a window is hit.

Winnowing: of every ``span - gram + 1`` consecutive gram hashes the smallest is kept. A document
and an item that share a window share all gram hashes inside it, so both keep the same smallest
one: no shared window can be missed. Documents whose fingerprints meet a benchmark fingerprint are
read again; there each matching gram is extended to the windows around it, and these are compared
word by word. Items of fewer than ``span`` words have no full window of grams; their own length is
used as the gram, without winnowing.

Defined cases: a null or wordless text has no words, no hits and the hash of the empty string as
``items_sha256``; an item without words is never found; items that repeat are each reported;
repeated document rows each give one row; a null ``doc_id`` or ``item_id`` is kept (a null item id
is not listed). Other columns of the inputs are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import ascii_lower, row_hash, stage

SPAN = 10
GRAM = 5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _item(words: str, at: Column) -> Column:
    return F.get(F.col(words), at)


def _grams(words: str, size: int) -> Column:
    """Hash of every run of ``size`` words."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[_item(words, i + j) for j in range(size)]))
    return F.when(n >= size, each).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: str, window: int) -> Column:
    """Distinct smallest hashes of all runs of ``window`` hashes."""
    n = F.size(grams)
    if window == 1:
        return F.array_distinct(F.col(grams))
    least = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*[_item(grams, i + j) for j in range(window)]))
    return F.when(n >= window, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _joined(words: str, start: Column, size: int) -> Column:
    return F.concat_ws(" ", *[_item(words, start + j) for j in range(size)])


def _fingerprints(df: DataFrame, short: list[int], span: int, gram: int) -> DataFrame:
    """Adds ``prints``: winnowed hashes, and all grams of the lengths of short items."""
    df = df.withColumn("grams", _grams("words", gram))
    parts = [_winnowed("grams", span - gram + 1), *[F.array_distinct(_grams("words", m)) for m in short]]
    return df.withColumn("prints", F.array_distinct(F.concat(*parts)))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """item_id (text), window (its words joined by a space) and size."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")
    starts = F.when(n >= span, F.sequence(F.lit(0), n - span)).when(n > 0, F.array(F.lit(0)))
    rows = items.withColumn("start", F.explode(starts))
    full, whole = _joined("words", F.col("start"), span), F.array_join("words", " ")
    return rows.select("item_id", F.when(n >= span, full).otherwise(whole).alias("window"), F.least(n, F.lit(span)).alias("size")).distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document: id, row_hash, n_words, n_hit, items (sorted), starts of the windows hit."""
    if not 0 < gram <= span:
        raise ValueError("gram must be from 1 to span")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    windows = stage(benchmark_windows(items, "item_id", "text", span), "windows")
    short = sorted(r[0] for r in windows.where(F.col("size") < span).select("size").distinct().collect())  # below span values
    sizes = windows.select("window").distinct().select(F.split("window", " ").alias("words"))
    known = stage(_fingerprints(sizes, short, span, gram).select(F.explode("prints").alias("print")).distinct(), "prints")

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = texts.select("doc_id", row_hash(F.col("text")).alias("row_hash"), words_of(F.col("text")).alias("words"))
    narrow = _fingerprints(base, short, span, gram).select("doc_id", "row_hash", F.size("words").cast("long").alias("n_words"), "prints")
    narrow = stage(narrow, "fingerprints")

    met = narrow.select("doc_id", "row_hash", F.explode("prints").alias("print")).join(known, "print")
    found = stage(met.groupBy("doc_id", "row_hash").agg(F.collect_set("print").alias("met")), "met")  # at most one document's own

    near = texts.withColumn("row_hash", row_hash(F.col("text"))).alias("d").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.row_hash") == F.col("f.row_hash"))
    )
    near = near.select(F.col("d.doc_id").alias("doc_id"), F.col("d.row_hash").alias("row_hash"), "met", words_of(F.col("text")).alias("words"))
    spots = []
    for size, part in [(span, gram), *[(m, m) for m in short]]:
        grams = near.select("doc_id", "row_hash", "met", "words", _grams("words", part).alias("grams"))
        at = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains("met", F.get(F.col("grams"), i)))
        first, last = F.lit(0), F.size("words") - size
        around = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (size - part), first), F.greatest(F.least(p, last), F.greatest(p - (size - part), first)))))
        starts = F.when(F.size("words") >= size, F.array_distinct(around))
        rows = grams.withColumn("start", F.explode(starts)).where(F.col("start") <= last)
        spots.append(rows.select("doc_id", "row_hash", "start", F.lit(size).alias("size"), _joined("words", F.col("start"), size).alias("window")))
    spot = spots[0]
    for more in spots[1:]:
        spot = spot.unionByName(more)
    hits = spot.join(windows.drop("size"), "window").groupBy("doc_id", "row_hash").agg(
        F.collect_set(F.struct("start", "size")).alias("starts"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    out = narrow.drop("prints").alias("n").join(
        hits.alias("h"), F.col("n.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("n.row_hash") == F.col("h.row_hash")), "left"
    )
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    return out.select(
        F.col("n.doc_id").alias("doc_id"),
        F.col("n.row_hash").alias("row_hash"),
        "n_words",
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("starts", F.array().cast("array<struct<start:int,size:int>>")).alias("starts"),
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns: item ids as a hash of their sorted list."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
