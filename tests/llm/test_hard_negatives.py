import math

import numpy as np
import pytest

from courtspark.llm import hard_negatives as H


def brute(rows):
    ok = []
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = lambda i: math.inf if i is None else i
    out = []
    for a, q, label in ok:
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v, strict=True)), last(i), i, b) for i, v, b in ok if len(v) == len(q)), key=lambda t: t[:2])
        for p, _, positive, _ in [s for s in scored if s[3] == label and s[2] != a][:5]:
            below = [s for s in scored if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(a, positive, k + 1, s[2], -p, -s[0]) for k, s in enumerate(below[:5])]
    return sorted(out, key=str)


def clustered(n=1500, dim=6):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (12, dim))
    rows = [(i, (centres[i % 12] + r.normal(0, 0.15, dim)).tolist(), int(r.integers(0, 4))) for i in range(n)]
    return rows + [(2000 + i, rows[100][1], i % 3) for i in range(40)] + [(3000, [0.0] * dim, 1), (3100, [-x for x in rows[200][1]], 1)]


@pytest.mark.parametrize("chunk,block", [(4096, 256), (150, 3)])
def test_against_brute_force(spark, chunk, block):
    rows = clustered() + [(4000, None, 1), (4100, [], 1), (4200, [math.nan] * 6, 1), (4300, [None] * 6, 1), (4400, [1.0] * 6, None), (4500, [1.0, 2.0], 1), (4501, [1.0, 1.5], 1), (4502, [1.0, 1.4], 2), (None, [1.0, 1.3], 3), (4600, [math.inf] * 6, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS `key`", "2 AS cell", "3 AS vector", "4 AS score", "5 AS dim")
    got = sorted(map(tuple, H.mine(df, chunk=chunk, block=block).collect()), key=str)
    assert got == brute(rows)
    assert len(got) > 100
    assert H.mine(df.limit(0)).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.85, 0.0], 2), (2, [0.85, 0.0], 2)]
    got = H.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == sorted([(100, 1, r, 2, 58880, 55552) for r in (1, 2)] * 2)


def test_nodes_hold_their_points_and_windows_skip_nodes():
    points = np.floor(256 * np.array([v for _, v, _ in clustered()]))
    tree = H.CoverTree(points)
    norm = (points**2).sum(1)
    high = np.c_[points, np.sqrt(norm.max() - norm)] / math.sqrt(norm.max())

    def below(node):
        kids = range(tree.begin[node], tree.end[node])
        return [tree.centre[node]] if not kids else [x for k in kids for x in below(k)]

    assert sorted(below(0)) == list(range(len(points)))
    inner = [n for n in range(len(tree.centre)) if tree.end[n]]
    assert len(inner) > 20
    for n in inner:
        assert np.linalg.norm(high[below(n)] - high[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-7
    seen = []
    exact = tree.products
    tree.products = lambda rows, q: seen.extend(rows) or exact(rows, q)
    score = (points @ points[7]).astype(int)
    (s, r), = tree.best(points[7], np.ones(len(points), bool), np.arange(len(points)), [(-math.inf, math.inf)], 5)
    order = np.lexsort((np.arange(len(points)), -score))[:5]
    assert s.tolist() == score[order].tolist() and r.tolist() == order.tolist()
    assert len(seen) < len(points) / 2


def test_large_numbers_are_exact_or_raise():
    big = np.array([[2.0**40, 3.0], [2.0**21, 5.0]])
    tree = H.CoverTree(big)
    assert tree.products(np.array([1]), np.array([2.0**40, 1.0])).tolist() == [2**61 + 5]
    with pytest.raises(OverflowError):
        tree.products(np.array([0]), np.array([2.0**40, 1.0]))
