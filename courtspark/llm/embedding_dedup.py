"""Near-duplicate vectors by counting collisions of projections.

Unit vectors of cosine c are sqrt(2 - 2c) apart, and a random Gaussian projection of their difference
is normal with that deviation. Vectors are sorted along many such lines. Two vectors collide on a line
when the second lies in a window around the first; pairs that collide on enough lines are compared
exactly in double precision. The count is the largest one that a pair just at the threshold still
reaches with the wanted probability (a binomial tail); closer pairs reach it more often. The window of
the first line is wider, as pairs outside of it are not seen at all.

Vectors with equal components and label are one node. Nodes are cut into cells of the first line, one
window wide, so that partners are in the same or the next cell; cells with many nodes are cut into
chunks, and pairs of chunks are the groups that tasks work on. A task holds two chunks at most.

Only vectors with equal labels and equal length are compared. Defined cases: a vector without label,
null, empty, zero or with a null or non-finite component links with nothing and is its own component;
rows that repeat a vector, also under one id, link with each other; a null ``vec_id`` is never a
component's name while another id is there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import small_batches, stage
from courtspark.llm.components import components

COSINE = 0.98
LINES = 24
#: Half windows in deviations of a pair just at the threshold: first line, other lines.
FIRST_WIDTH, WIDTH = 4.5, 3.0
RECALL = 0.9999
CHUNK = 4096
SEED = 7
_STRIP = 256


def needed(lines: int = LINES, width: float = WIDTH, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for count in range(lines, 0, -1):
        tail += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if tail >= recall:
            return count
    return 1


def lines_of(dim: int, lines: int = LINES) -> np.ndarray:
    """One Gaussian direction for the cells, then ``lines`` for the count."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, lines + 1))


def _deviation(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def _prepare(cosine: float, lines: int):
    window = FIRST_WIDTH * _deviation(cosine)

    def run(batches):
        ways: dict[int, np.ndarray] = {}
        for batch in batches:
            nodes, cells, vectors = [], [], []
            for label, vector in zip(batch.column("label").to_pylist(), batch.column("vector"), strict=True):
                items = vector.as_py()
                node = cell = raw = None
                if label is not None and items and not any(x is None for x in items):
                    x = np.array(items, np.float64) + 0.0
                    norm = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
                    if 0 < norm < math.inf:
                        way = ways.setdefault(len(x), lines_of(len(x), lines))
                        raw = x.tobytes()
                        node = f"{label}|{len(x)}|{xxhash.xxh3_128_hexdigest(raw)}"
                        cell = math.floor(float(x @ way[:, 0]) / norm / window)
                nodes.append(node)
                cells.append(cell)
                vectors.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(nodes, pa.string()), pa.array(cells, pa.int64()), pa.array(vectors, pa.binary())],
                names=["vec_id", "label", "node", "cell", "vector"],
            )

    return run


def near_pairs(left: np.ndarray, right: np.ndarray | None, cosine: float, lines: int = LINES) -> np.ndarray:
    """Index pairs of rows with at least this cosine; without ``right``, within ``left``."""
    way = lines_of(left.shape[1], lines)
    inside, right = right is None, left if right is None else right
    d = _deviation(cosine)
    first, width, least = FIRST_WIDTH * d, WIDTH * d, needed(lines)
    norm_l, norm_r = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    at_l, at_r = (left @ way) / norm_l[:, None], (right @ way) / norm_r[:, None]
    by_l, by_r = np.argsort(at_l[:, 0], kind="stable"), np.argsort(at_r[:, 0], kind="stable")
    place = at_r[by_r, 0]
    found = []
    for begin in range(0, len(left), _STRIP):
        rows = by_l[begin : begin + _STRIP]
        line = at_l[rows, 0]
        low, high = np.searchsorted(place, line[0] - first), np.searchsorted(place, line[-1] + first, "right")
        near = by_r[low:high]
        count = np.zeros((len(rows), len(near)), np.int16)
        early = min(6, lines)
        for j in range(1, early + 1):
            count += np.abs(at_l[rows, j, None] - at_r[None, near, j]) <= width
        a, b = np.nonzero(count >= least - (lines - early))
        total = count[a, b]
        keep = np.abs(line[a] - at_r[near[b], 0]) <= first
        if inside:
            keep &= rows[a] < near[b]
        a, b, total = rows[a[keep]], near[b[keep]], total[keep]
        for j in range(early + 1, lines + 1):
            total = total + (np.abs(at_l[a, j] - at_r[b, j]) <= width)
            keep = total >= least - (lines - j)
            a, b, total = a[keep], b[keep], total[keep]
        exact = np.einsum("ij,ij->i", left[a], right[b]) / (norm_l[a] * norm_r[b])
        keep = exact >= cosine
        found.append(np.c_[a[keep], b[keep]])
    return np.concatenate(found) if found else np.zeros((0, 2), int)


def _compare(cosine: float, lines: int):
    def run(table: pa.Table) -> pa.Table:
        node, side = np.array(table.column("node").to_pylist(), object), np.asarray(table.column("side"))
        vectors = [np.frombuffer(v.as_buffer(), np.float64) for v in table.column("vector")]
        u, v = [], []
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inside = not table.column("apart")[0].as_py()
        if len(left) and (inside or len(right)):
            x = np.stack([vectors[i] for i in left])
            y = None if inside else np.stack([vectors[i] for i in right])
            pairs = near_pairs(x, y, cosine, lines)
            u, v = node[left][pairs[:, 0]].tolist(), node[left if inside else right][pairs[:, 1]].tolist()
        return pa.table({"u": pa.array(u, pa.string()), "v": pa.array(v, pa.string())})

    return run


def _groups(nodes: DataFrame, chunk: int) -> DataFrame:
    """Every node once for each pair of chunks it takes part in: group columns, side, vector."""
    keys = ["label", "dim", "cell"]
    many = stage(nodes.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "cells")
    after = many.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("next"))
    before = many.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("chunks").alias("last"))
    rows = nodes.join(many, keys).join(after, keys, "left").join(before, keys, "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def group(cell, a, b, side, apart):
        return F.struct(cell.alias("at"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"), apart.alias("apart"), F.lit(side).alias("part"))

    c, own, zero = F.col("cell"), F.col("own"), F.lit(0)
    here = F.transform(F.sequence(own, F.col("chunks") - 1), lambda b: group(c, own, b, 0, b != own))
    there = F.when(own > 0, F.transform(F.sequence(zero, own - 1), lambda a: group(c, a, own, 1, F.lit(True))))
    # the next cell's chunks are numbered after this cell's
    up = F.when(F.col("next") > 0, F.transform(F.sequence(zero, F.col("next") - 1), lambda b: group(c, own, F.col("chunks") + b, 0, F.lit(True))))
    down = F.when(F.col("last") > 0, F.transform(F.sequence(zero, F.col("last") - 1), lambda a: group(c - 1, a, F.col("last") + own, 1, F.lit(True))))
    none = F.array().cast("array<struct<at:bigint,a:int,b:int,side:int,apart:boolean,part:int>>")
    every = F.concat(here, *[F.coalesce(x, none) for x in (there, up, down)])
    return rows.select("label", "dim", "node", "vector", F.explode(every).alias("g")).select("label", "dim", "node", "vector", "g.at", "g.a", "g.b", "g.side", "g.apart")


def embedding_components(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, lines: int = LINES, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = small_batches(vectors).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    kind = "vec_id long, label string, node string, cell long, vector binary"
    rows = stage(rows.mapInArrow(_prepare(cosine, lines), kind), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("cell").alias("cell"), F.any_value("vector").alias("vector")
    )
    nodes = stage(nodes.withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "nodes")
    groups = _groups(nodes.select("node", "label", "dim", "cell", "vector"), chunk)
    links = groups.groupBy("label", "dim", "at", "a", "b", "apart").applyInArrow(_compare(cosine, lines), "u string, v string")
    links = stage(links.distinct(), "links")

    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both.join(nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("around"))
    named = nodes.select("node", "least", "copies").join(around, "node", "left").join(components(links), "node", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "node")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", (F.col("copies") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(stage(named, "named"), "node", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
