import math

import numpy as np
import pytest

from courtspark.llm import embedding_dedup as E


def brute(rows, cosine=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i].add(j)
    out = []
    for i, (name, *_rest) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((name, len(links[i]), least, name is not None and name == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_against_brute_force(spark, chunk):
    r = np.random.default_rng(8)
    rows = []
    for base in r.normal(0, 1, (40, 16)):
        for k in range(4):
            rows.append((base + r.normal(0, 0.02 + 0.03 * k, 16)).tolist())
    rows += [rows[0]] * 30 + [(2.0 * np.array(rows[5])).tolist()]
    rows = [(i, v, int(i % 160 < 120)) for i, v in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [math.nan] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [], 1), (907, [math.inf] * 16, 1)]
    rows += [(None, rows[3][1], rows[3][2]), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS cell", "3 AS vector")
    assert sorted(map(tuple, E.embedding_components(df, chunk=chunk).collect()), key=str) == brute(rows)
    assert E.embedding_components(df.limit(0)).count() == 0


def test_recall_of_pairs_at_the_threshold():
    assert E.needed(24, 3.0, 0.9999) == 22
    r = np.random.default_rng(2)
    a = r.normal(0, 1, (3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.normal(0, 1, a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    angle = math.acos(0.9801)
    b = math.cos(angle) * a + math.sin(angle) * side
    found = E.near_pairs(a, b, 0.98)
    assert (found[:, 0] == found[:, 1]).sum() >= 0.999 * len(a)
