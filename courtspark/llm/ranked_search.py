"""Ranked lexical search, exact, over posting lists that are cut into blocks of similar documents.

One pass over the texts keeps, for every document with a term, its length and the terms that occur in a
query, with their counts; document frequencies and the two totals are added up from these. A document's
score is a sum of whole-number parts, one per term of the query.

The search takes documents in segments. Inside a segment the posting list of a term is clustered: documents
are assigned to the most similar of a few spread ones of the list, by a projection of their parts, and the
clusters are cut into blocks. Each block keeps the coordinatewise maximum of its documents' parts. A query
takes its lists from the term with the largest possible part to the smallest. In the i-th list only
documents without an earlier term are new, so a block's bound is the sum of its maxima over the i-th and all
later terms; the block is skipped only when that bound is below the score of the 50th best document so far
(``top``-th). What is left is scored exactly from the documents' own parts. The best documents
are kept from one segment of a task to its next, so bounds get sharper; tasks hand on their ``top`` documents for
each query, and the best of these are the answer. Nothing is approximate.

Queries are searched in slices of at most ``MAX_TERMS`` terms with repeats; a segment has at most ``CELLS``
document-term cells (or one document), so memory is bounded whatever the texts are. A slice's queries are passed to
the tasks as a broadcast of that size.

Defined cases: a null or empty text, or one without terms, is no document and finds nothing as a query; equal scores
go by ascending id, ids that are null last; rows that repeat an id are documents (or queries) of their own; a
query that finds nothing has no rows; empty tables give an empty table; other columns do no harm.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm.common import column, stage

TOP = 50
#: Query terms, with repeats between queries, that are searched at a time.
MAX_TERMS = 1_000_000
#: Document-term cells of a segment, and documents, at most.
CELLS, DOCUMENTS = 4_000_000, 4096
#: Documents of a block at most; lists no longer than this are scored without bounds.
BLOCK = 64
#: Documents of short lists that are scored at once.
TOGETHER = 256
#: Cells of the maxima that a segment keeps from query to query.
KEPT = 8_000_000
#: Directions that similarity is measured along.
DIRECTIONS = 24
NO_ID = np.iinfo(np.int64).max

_BREAKS = bytes(b for b in range(128) if chr(b) not in string.ascii_letters + string.digits)
_FOLD = bytes.maketrans(_BREAKS + string.ascii_uppercase.encode(), b" " * len(_BREAKS) + string.ascii_lowercase.encode())


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and all characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def part(weight: int, tf: int, m: int) -> int:
    """What a term that occurs ``tf`` times adds to the score of a document with length factor ``m``."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Queries(NamedTuple):
    """``start[i]:start[i + 1]`` are the terms of query i, as places in ``vocabulary``."""

    keys: list[int]
    start: np.ndarray
    term: np.ndarray
    vocabulary: list[bytes]


def _slices(items: DataFrame, max_terms: int) -> Iterator[Queries]:
    """Queries with their distinct terms. Rows come to the driver one by one, and as slices go on."""
    held: list[tuple[int, set[bytes]]] = []
    size = 0

    def out() -> Queries:
        vocabulary = sorted(set().union(*(t for _, t in held)))
        place = {t: i for i, t in enumerate(vocabulary)}
        return Queries(
            [k for k, _ in held], np.cumsum([0, *(len(t) for _, t in held)]), np.array([place[t] for _, own in held for t in sorted(own)], np.int64), vocabulary
        )

    for row in items.select("query", "text").toLocalIterator():
        own = set(terms(row.text))
        if held and size + len(own) > max_terms:
            yield out()
            held, size = [], 0
        held.append((row["query"], own))
        size += len(own)
    if held:
        yield out()


def _counted(vocabulary):
    def run(batches):
        place = {t: i for i, t in enumerate(vocabulary.value)}
        for batch in batches:
            ids, length, term, tf = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms(text.as_py())
                if words:
                    own = sorted((place[t], c) for t, c in Counter(words).items() if t in place)
                    ids.append(doc_id)
                    length.append(len(words))
                    term.append([t for t, _ in own])
                    tf.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(length, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["doc_id", "n", "term", "tf"]
            )

    return run


def _frequencies(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("term").flatten(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    return run


class Segment:
    """Parts of all query terms in some documents (``parts``: documents by terms) and the blocks of each list."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, block: int = BLOCK):
        self.ids, self.parts = ids, parts
        way = np.random.default_rng(parts.shape[1]).standard_normal((parts.shape[1], DIRECTIONS)).astype(np.float32)
        self.place = np.sqrt(parts).astype(np.float32) @ way
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), 1e-9)
        self.most = parts.max(0)
        by_term, self.postings = np.nonzero(parts.T)
        self.ends = np.searchsorted(by_term, np.arange(parts.shape[1] + 1))
        self.block, self.kept = block, 0
        self.lists: dict[int, tuple[list[np.ndarray], np.ndarray | None]] = {}

    def blocks(self, term: int) -> tuple[list[np.ndarray], np.ndarray | None]:
        """Documents of each block of a list, and the blocks' maxima; a short list is one block without."""
        if term not in self.lists:
            rows = self.postings[self.ends[term] : self.ends[term + 1]]
            if len(rows) <= self.block:
                self.lists[term] = [rows], None
            else:
                own = self.place[rows]
                count = math.ceil(len(rows) / self.block)
                spread = own[np.linspace(0, len(rows) - 1, count).astype(int)]
                nearest = (own @ spread.T).argmax(1)
                order = np.argsort(nearest, kind="stable")
                ends = np.flatnonzero(np.diff(nearest[order])) + 1
                cut = [b[i : i + self.block] for b in np.split(rows[order], ends) for i in range(0, len(b), self.block)]
                self.kept += len(cut) * self.parts.shape[1]
                if self.kept > KEPT:
                    self.lists, self.kept = {}, len(cut) * self.parts.shape[1]
                self.lists[term] = cut, np.array([self.parts[b].max(0) for b in cut])
        return self.lists[term]


class Best:
    """The highest scores of a query so far, equal ones by id."""

    def __init__(self, top: int):
        self.top, self.score, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document needs this score at least."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least
        score, ids = np.concatenate([self.score, score[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, -score))[: self.top]
        self.score, self.ids = score[order], ids[order]


def search_segment(segment: Segment, term: np.ndarray, best: Best) -> int:
    """Offers to ``best`` all documents of the segment that can be among the best. Gives how many were
    scored."""
    term = term[segment.most[term] > 0]
    term = term[np.argsort(-segment.most[term], kind="stable")]
    rest = np.cumsum(segment.most[term][::-1])[::-1]
    seen = np.zeros(len(segment.ids), bool)

    def score(rows: np.ndarray) -> None:
        rows = rows[~seen[rows]]
        if len(rows):
            seen[rows] = True
            best.offer(segment.parts[rows[:, None], term].sum(1), segment.ids[rows])

    short: list[np.ndarray] = []
    for i, t in enumerate(term.tolist()):
        if rest[i] < best.least:
            break
        lists, maxima = segment.blocks(t)
        if maxima is None:
            short.append(lists[0])
            if sum(map(len, short)) < TOGETHER:
                continue
        if short:
            score(np.unique(np.concatenate(short)))
            short = []
        if maxima is not None:
            bound = maxima[:, term[i:]].sum(1)
            for b in np.argsort(-bound, kind="stable"):
                if bound[b] < best.least:
                    break
                score(lists[b])
    if short:
        score(np.unique(np.concatenate(short)))
    return int(seen.sum())


def _segments(batches, weights: np.ndarray, total: int, documents: int, cells: int, most: int) -> Iterator[Segment]:
    ids: list[np.ndarray] = []
    held: list[tuple] = []
    rows = 0

    def out() -> Segment:
        doc = np.repeat(np.arange(rows), np.concatenate([h[1] for h in held]))
        term, tf, n = (np.concatenate([h[k] for h in held]) for k in (2, 3, 0))
        m = 50 + [50 * int(x) * documents // total for x in n] if 50 * int(n.max()) * documents >= 1 << 62 else 50 + 50 * n * documents // total
        parts = np.zeros((rows, len(weights)), np.int64)
        parts[doc, term] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.asarray(m)[doc]))
        return Segment(np.concatenate(ids), parts)

    limit = max(1, min(most, cells // max(1, len(weights))))
    for batch in batches:
        for begin in range(0, batch.num_rows, limit):
            piece = batch.slice(begin, limit)
            if rows and rows + piece.num_rows > limit:
                yield out()
                ids, held, rows = [], [], 0
            ids.append(np.asarray(piece.column("doc_id").fill_null(NO_ID)))
            term, tf = piece.column("term"), piece.column("tf")
            sizes = np.asarray(term.value_lengths())
            held.append((np.asarray(piece.column("n")), sizes, np.asarray(term.flatten()), np.asarray(tf.flatten(), np.int64)))
            rows += piece.num_rows
    if rows:
        yield out()


def _searched(queries, weights: np.ndarray, total: int, documents: int, top: int, cells: int, most: int):
    def run(batches):
        start, term, keys = queries.value
        best = [Best(top) for _ in keys]
        for segment in _segments(batches, weights, total, documents, cells, most):
            for i, own in enumerate(best):
                search_segment(segment, term[start[i] : start[i + 1]], own)
        for key, own in zip(keys, best, strict=True):
            if len(own.ids):
                ids = pa.array(own.ids, mask=own.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), ids, pa.array(own.score)], names=["query", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, max_terms: int = MAX_TERMS, cells: int = CELLS, most: int = DOCUMENTS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    asked = items.select(F.monotonically_increasing_id().alias("query"), column(item_col).alias("item_id"), column(item_text_col).alias("text"))
    asked = stage(asked, "queries")
    found = None
    for slice_ in _slices(asked, max_terms):
        words = spark.sparkContext.broadcast(slice_.vocabulary)
        counted = stage(texts.mapInArrow(_counted(words), "doc_id long, n long, term array<int>, tf array<int>"), "counted")
        documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        size = len(slice_.vocabulary)
        df = np.zeros(size, np.int64)
        if size and documents:
            for row in counted.mapInArrow(_frequencies(size), "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # one row per query term
                df[row[0]] = row[1]
        weights = np.array([weight(int(x), documents) for x in df], np.int64)
        queries = spark.sparkContext.broadcast((slice_.start, slice_.term, slice_.keys))
        scored = counted.select("doc_id", "n", "term", "tf").mapInArrow(_searched(queries, weights, total, documents, top, cells, most), "query long, doc_id long, score long")
        scored = stage(scored, "scored")
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
