import random

import numpy as np
import pytest

from courtspark.llm import ngram_join as J
from courtspark.llm.components import components


def brute(rows, percent=80):
    words = J._Words()
    sets = [set(J.shingles(t, words).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and sets[j]:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("load", [2.5, 9.0, 40.0])  # few segments need one-deletion neighbourhoods and the last key
def test_against_brute_force(spark, load):
    r = random.Random(11)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage, texts = text(40), []
    for n in (4, 5, 6, 7, 9, 12, 18, 30, 60, 120, 300):
        for _ in range(3):
            texts += near_copies(r, text(n), 7, max(1, n // 25))
    texts += [f"{text(12)} {passage} {text(9)}" for _ in range(25)] + [passage] * 5 + near_copies(r, text(90), 60, 5)
    rows = list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "oNE"), (None, "oNE"), (None, "alone without id")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.jaccard_components(df, load=load).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_similar_sets_share_a_key():
    r = np.random.default_rng(5)
    for load in (1.0, 2.5, 6.0, 30.0):
        for _ in range(400):
            n = int(r.integers(1, 90))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            gone = int(r.integers(0, max(1, n // 4) + 1))
            b = np.unique(np.r_[a[gone:], r.integers(0, 2**63, int(r.integers(0, n // 6 + 1))).astype(np.uint64)])
            common = np.sort(r.choice(a, len(a) // 2, replace=False))
            if len(b) and J.similar(a, b):
                assert len(np.intersect1d(J.segment_keys(a, common, load=load), J.segment_keys(b, common, load=load)))


def test_parity_is_a_lower_bound():
    r = np.random.default_rng(6)
    a = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    for k in (0, 3, 40):
        b = np.sort(np.r_[a[k:], r.integers(0, 2**63, k).astype(np.uint64)])
        x, y = J.parity(a), J.parity(b)
        assert len(x) == len(y) and np.bitwise_count((x ^ y).view(np.uint64)).sum() <= 2 * k


def test_odd_rows_and_empty_tables(spark, odd_documents):
    got = J.jaccard_components(odd_documents)
    assert got.count() == odd_documents.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got.collect()}
    assert by[4, 1] == 3 and by[3, 1] == 3 and by[1, 0] == 1 and by[2, 0] == 2 and by[6, 0] == 6 and by[None, 5] is None
    assert J.jaccard_components(odd_documents.limit(0)).count() == 0
    assert {r.component_id for r in J.jaccard_components(odd_documents.where("doc_id IN (1, 2)")).collect()} == {1, 2}


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(50)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    pairs += [(7, 7), (None, 3), (900, 900)]
    root = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a in root and b in root:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {x.node: x.component for x in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_large_family_of_near_copies(spark):
    """Copies of one text with up to half of the words changed: one large component, and many that link with nothing."""
    r = random.Random(3)
    base = " ".join(f"w{r.randrange(10**6)}" for _ in range(150))
    texts = near_copies(r, base, 800, 14)
    words = J._Words()
    sets = [J.shingles(t, words) for t in texts]
    every = np.unique(np.concatenate(sets))
    there = np.zeros((len(sets), len(every)), np.float32)
    for i, s in enumerate(sets):
        there[i, np.searchsorted(every, s)] = 1
    size, both = there.sum(1), there @ there.T
    near = 100 * both >= 80 * (size[:, None] + size - both)
    least = np.arange(len(sets))
    while True:
        now = np.where(near, least[None], len(sets)).min(1)
        if (now == least).all():
            break
        least = now
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in J.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(sets))] == least.tolist()
    assert np.bincount(least).max() > 200 and len(set(least.tolist())) > 200
