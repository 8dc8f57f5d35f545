"""Hard negatives by cover trees over norm-augmented vectors, exact.

Vectors of whole numbers get one more component, sqrt(M^2 - |x|^2) with M the largest norm of a tree, so that all
lie on one sphere. For a query q, stretched to length M, the distance to a point x of the sphere gives the inner
product and back. A node has a centre and the largest distance of its points from it, so its points' inner
products lie in an interval; the levels' covering radii shrink by ``BASE``. Descent is best-first, by the upper end
of the interval. A node is skipped when its interval is outside of all wanted windows, or below the last score
wanted; single points are compared by exact whole-number inner products.

Rows are ordered by vector length, label and nearest of a few pivots, and cut into trees of at most ``CHUNK`` rows, each a row of
a written index. Queries are packed into blocks and joined with the trees; a tree without a row of a wanted label
is not sent to them. Each pair of a tree and a block is a unit of work. A first search finds the
positives of every anchor, a second one the rows of other labels within a window below each positive's score.
Each search keeps the best few of every tree, then of all trees. Pivots come from at most ``SAMPLE`` rows; they
only place rows, results do not depend on them.

Defined cases: a row with a null label or vector, an empty vector, or a null or non-finite component takes no part;
vectors are compared with those of equal length; a null id is no anchor and comes last among equal scores; rows
that repeat an id count each, but a row with the anchor's id is not its positive; equal vectors tie by id; an
anchor without positives, or a positive without negatives, has no rows; a window above a negative score is empty;
whole-number vectors whose products leave 63 bits raise ``OverflowError``; empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm.common import column, stage

CHUNK, BLOCK = 4096, 256
BASE = 1.3
PIVOTS, SAMPLE = 64, 2048
#: Groups of this size are not cut further.
LEAF = 16
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as got:
        return {k: got[k] for k in got.files}


def _small(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = np.abs(v).max(initial=0)
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def spread(points: np.ndarray, first: int, radius: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Centres, farthest first, until all points are within ``radius`` of one; each point's centre and distance.
    None if that takes more than ``most`` centres."""
    square = np.einsum("ij,ij->i", points, points)
    centres, near, best = [], np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    at = first
    while True:
        d = np.maximum(square + square[at] - 2 * (points @ points[at]), 0)
        closer = d < best
        best[closer], near[closer] = d[closer], len(centres)
        best[at], near[at] = 0, len(centres)
        centres.append(at)
        at = int(best.argmax())
        if best[at] <= radius * radius:
            return np.array(centres), near, np.sqrt(best)
        if len(centres) >= most:
            return None


class CoverTree:
    """Nodes in arrays: ``centre`` (place of a vector), ``radius``, and children ``begin:end``, which follow one
    another; a node without children is a single point."""

    def __init__(self, vectors: np.ndarray, arrays: dict[str, np.ndarray] | None = None):
        self.vectors = vectors.astype(np.float64)
        norm = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.square = float(norm.max(initial=0))
        if arrays is None:
            # scaled to the unit sphere: distances only bound, never decide
            scale = math.sqrt(self.square) or 1.0
            high = np.c_[self.vectors, np.sqrt(np.maximum(self.square - norm, 0))] / scale
            self._grow(high)
        else:
            self.centre, self.radius, self.begin, self.end = (arrays[k] for k in ("centre", "radius", "begin", "end"))

    def _grow(self, high: np.ndarray) -> None:
        n = len(high)
        centre, radius, begin, end = [0], [float(np.linalg.norm(high - high[:1], axis=1).max(initial=0))], [0], [0]
        todo = [(0, np.arange(n), radius[0])] if n else []
        while todo:
            node, rows, cover = todo.pop()
            own = int(np.flatnonzero(rows == centre[node])[0])
            groups = None
            if len(rows) > LEAF and radius[node] > 1e-9:
                groups = spread(high[rows], own, min(cover, radius[node]) / BASE, len(rows) // 2)
            begin[node] = len(centre)
            if groups is None:
                centre += rows.tolist()
                radius += [0.0] * len(rows)
                begin += [0] * len(rows)
                end += [0] * len(rows)
            else:
                centres, near, far = groups
                for k, c in enumerate(centres):
                    mine = near == k
                    r = float(far[mine].max())
                    centre.append(int(rows[c]))
                    radius.append(r)
                    begin.append(0)
                    end.append(0)
                    if mine.sum() > 1:
                        todo.append((len(centre) - 1, rows[mine], min(cover, radius[node]) / BASE))
            end[node] = len(centre)
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.begin, self.end = np.array(begin), np.array(end)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"centre": self.centre, "radius": self.radius, "begin": self.begin, "end": self.end}

    def products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products. Whole numbers in doubles are exact below 2^53; larger ones take Python's."""
        size = self.square * float(q @ q)
        if size < EXACT * EXACT:
            return (self.vectors[rows] @ q).astype(np.int64)
        big = [int(x) for x in q]
        return np.array([sum(int(a) * b for a, b in zip(v, big, strict=True)) for v in self.vectors[rows]], dtype=np.int64)

    def best(self, q: np.ndarray, wanted: np.ndarray, ids: np.ndarray, windows: list[tuple[float, float]], few: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (from, to): scores and places of its ``few`` best wanted points, ties by id."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        need = [low for low, _ in windows]
        q = q.astype(np.float64)
        square = float(q @ q)
        stretch = math.sqrt(square * self.square)  # |q| M; inner product = stretch * (1 - d^2 / 2) on the unit sphere
        slack = 1 + 1e-6 * stretch  # distances near 0 are exact to some 1e-8

        def offer(rows: np.ndarray, score: np.ndarray) -> None:
            for w, (_, high) in enumerate(windows):
                fit = (score <= high) & (score >= need[w])
                if not fit.any():
                    continue
                s, r = np.concatenate([found[w][0], score[fit]]), np.concatenate([found[w][1], rows[fit]])
                if len(s) > 4 * few:
                    keep = s >= np.partition(s, len(s) - few)[len(s) - few]
                    s, r = s[keep], r[keep]
                order = np.lexsort((ids[r], -s))[:few]
                found[w] = s[order], r[order]
                if len(order) == few:
                    need[w] = max(windows[w][0], s[order[-1]])

        heap: list[tuple[float, float, int]] = []

        def push(nodes: np.ndarray, score: np.ndarray) -> None:
            d = np.sqrt(np.clip(2 - 2 * score / stretch, 0, 4)) if stretch else np.zeros(len(nodes))
            r = self.radius[nodes]
            high = stretch * (1 - np.maximum(d - r, 0) ** 2 / 2) + slack
            low = stretch * (1 - np.minimum(d + r, 2) ** 2 / 2) - slack
            for h, lo, node in zip(high.tolist(), low.tolist(), nodes.tolist(), strict=True):
                if any(h >= need[w] and lo <= windows[w][1] for w in range(len(windows))):
                    heapq.heappush(heap, (-h, lo, node))

        if len(self.vectors):
            push(np.zeros(1, np.int64), self.products(self.centre[:1], q))
        while heap:
            high, low, node = heapq.heappop(heap)
            if -high < min(need):
                break
            if not any(-high >= need[w] and low <= windows[w][1] for w in range(len(windows))):
                continue
            nodes = np.arange(self.begin[node], self.end[node])
            rows = self.centre[nodes]
            score = self.products(rows, q)
            single = self.end[nodes] == 0
            mine = single & wanted[rows]
            offer(rows[mine], score[mine])
            if not single.all():
                push(nodes[~single], score[~single])
        return found


def _cells(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            cells = []
            for v in batch.column("vector"):
                x = np.asarray(v.values)
                p = pivots.get(len(x))
                cells.append(0 if p is None else int((p @ x - np.einsum("ij,ij->i", p, p) / 2).argmax()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _in_chunks(batches: Iterable[pa.RecordBatch], most: int):
    """Runs of at most ``most`` rows with vectors of one length, in order."""
    held, rows, dim = [], 0, None
    for batch in batches:
        sizes = np.asarray(batch.column("dim"))
        at = 0
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and sizes[end] == sizes[at] and end - at < most:
                end += 1
            if rows and (dim != sizes[at] or rows + end - at > most):
                if dim == sizes[at]:
                    end = min(end, at + most - rows)
                    if end > at:
                        held.append(batch.slice(at, end - at))
                        at = end
                yield pa.Table.from_batches(held)
                held, rows = [], 0
                continue
            held.append(batch.slice(at, end - at))
            rows, dim, at = rows + end - at, sizes[at], end
    if rows:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("vector").combine_chunks().flatten()).reshape(table.num_rows, -1)


def _trees(chunk: int):
    def run(batches):
        for i, table in enumerate(_in_chunks(batches, chunk)):
            vectors, label = _matrix(table), np.asarray(table.column("label"))
            tree = CoverTree(vectors)
            data = _packed(vectors=_small(vectors), label=label, id=np.asarray(table.column("vec_id").combine_chunks().fill_null(NO_ID)), **tree.arrays())
            number = (TaskContext.get().partitionId() << 32) + i
            columns = [pa.array([x]) for x in (number, int(label.min()), int(label.max()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([vectors.shape[1]], pa.int32()), pa.array([data], pa.binary())], names=["tree", "least", "most", "dim", "data"])

    return run


def _blocks(block: int):
    def run(batches):
        for i, table in enumerate(_in_chunks(batches, block)):
            label = np.asarray(table.column("label"))
            goals = table.column("goals").combine_chunks()
            data = _packed(vectors=_small(_matrix(table)), label=label, key=np.asarray(table.column("key")), id=np.asarray(table.column("vec_id")), sizes=np.asarray(goals.value_lengths()), goals=np.asarray(goals.flatten()))
            number = (TaskContext.get().partitionId() << 32) + i
            columns = [pa.array([x]) for x in (number, int(label.min()), int(label.max()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([table.column("dim")[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["block", "first", "last", "dim", "asked"])

    return run


def _searched(few: int, positives: bool, share: tuple[int, int]):
    """One row per hit. Positives: the best rows of the anchor's label, with ``goal`` null. Else the best rows of other
    labels for every goal g with ``share`` low * g <= high * score <= high * g."""

    def run(batches):
        for batch in batches:
            for data, asked in zip(batch.column("data"), batch.column("asked"), strict=True):
                t, a = _unpacked(data.as_py()), _unpacked(asked.as_py())
                tree, ends = CoverTree(t["vectors"], t), np.cumsum(a["sizes"])
                out: list[tuple] = []
                for i, q in enumerate(a["vectors"]):
                    wanted = (t["label"] == a["label"][i]) & (t["id"] != a["id"][i]) if positives else t["label"] != a["label"][i]
                    if not wanted.any():
                        continue
                    goals = a["goals"][ends[i] - a["sizes"][i] : ends[i]].tolist()
                    windows = [(-math.inf, math.inf)] if positives else [(-(-share[0] * g // share[1]), g) for g in goals]
                    for w, (score, rows) in enumerate(tree.best(q, wanted, t["id"], windows, few)):
                        out += [(int(a["key"][i]), None if positives else goals[w], int(t["id"][r]), int(s)) for s, r in zip(score, rows, strict=True)]
                key, goal, ids, score = zip(*out, strict=True) if out else ((), (), (), ())
                ids = [None if x == NO_ID else x for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, goal, ids, score)], names=["key", "goal", "vec_id", "score"])

    return run


def pivots(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Spread vectors of a bounded sample, by vector length."""
    got = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("dim", "vector").toArrow()
    out = {}
    for dim in set(got.column("dim").to_pylist()):
        v = np.array([x.as_py() for x, d in zip(got.column("vector"), got.column("dim"), strict=True) if d.as_py() == dim])
        chosen, best = [0], np.full(len(v), np.inf)
        while len(chosen) < min(count, len(v)):
            best = np.minimum(best, ((v - v[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(best.argmax()))
        out[dim] = v[chosen]
    return out


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """key, vec_id, label, dim, vector: rows that take part, components floored after scaling."""
    v = column(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(column(label_col).isNotNull() & (F.size(v) > 0) & fine)
    floored = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("key"), column(id_col).cast("long").alias("vec_id"), column(label_col).cast("long").alias("label"), F.size(v).alias("dim"), floored.alias("vector"))


def build_index(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Trees of all rows of ``whole_vectors``: tree, least and most label, dim, data."""
    placed = rows.mapInArrow(_cells(pivots(rows)), "key long, vec_id long, label long, dim int, vector array<double>, cell int")
    parts = max(1, min(2000, math.ceil(rows.count() / chunk)))
    ordered = placed.repartitionByRange(parts, "dim", "label", "cell", "key").sortWithinPartitions("dim", "label", "cell", "key")
    return stage(ordered.mapInArrow(_trees(chunk), "tree long, least long, most long, dim int, data binary"), "trees")


def search(index: DataFrame, asked: DataFrame, few: int, positives: bool, share: tuple[int, int] = (80, 100), block: int = BLOCK) -> DataFrame:
    """``asked`` has key, vec_id, label, dim, vector, goals. Gives key, goal, vec_id, score, place (from 1)."""
    packed = asked.repartitionByRange("dim", "label", "key").sortWithinPartitions("dim", "label", "key")
    blocks = stage(packed.mapInArrow(_blocks(block), "block long, first long, last long, dim int, asked binary"), "blocks")
    slots = max(1, index.count())
    trees = index.withColumn("slot", F.pmod(F.xxhash64("tree"), F.lit(slots)))
    sent = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<long>")))
    if positives:
        useful = (F.col("least") <= F.col("last")) & (F.col("most") >= F.col("first"))
    else:  # not only the one label of all the block
        useful = ~((F.col("least") == F.col("most")) & (F.col("first") == F.col("last")) & (F.col("least") == F.col("first")))
    pairs = trees.join(sent, ["slot", "dim"]).where(useful)
    spread_out = pairs.select("tree", "block", "data", "asked").repartition(max(slots, 8), "tree", "block")
    hits = stage(spread_out.select("data", "asked").mapInArrow(_searched(few, positives, share), "key long, goal long, vec_id long, score long"), "hits")
    order = Window.partitionBy("key", "goal").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return stage(hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= few), "found")


def hard_negatives(rows: DataFrame, anchors: DataFrame, *, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100), chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``rows`` as from ``whole_vectors``, written; ``anchors`` are some of them. Gives anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    index = build_index(rows, chunk)
    none = F.array().cast("array<long>")
    found = search(index, anchors.withColumn("goals", none), n_positives, True, share, block)
    goals = found.groupBy("key").agg(F.sort_array(F.collect_set("score")).alias("goals"))  # at most n_positives
    below = search(index, anchors.join(goals, "key"), n_negatives, False, share, block)
    good = found.select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bad = below.select("key", F.col("goal").alias("positive_score"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = good.join(bad, ["key", "positive_score"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, *, every: int = 100, relabel: int = 7, labels: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Hard negatives of all rows whose id is divisible by ``every``, among all rows; where it is divisible by
    ``relabel`` the label first becomes (label + 1) % ``labels``."""
    rows = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = stage(rows.withColumn("label", moved), "rows")
    return hard_negatives(rows, rows.where(F.col("vec_id") % every == 0), chunk=chunk, block=block)
