import math
import re
from collections import Counter

import numpy as np
import pytest

from courtspark.llm import ranked_search as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    counted = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scores.append((-score, math.inf if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:50])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "漢字", "x2"]
    zipf = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda k: " ".join(r.choice(vocabulary, k, p=zipf / zipf.sum()))
    docs = [(i, draw(int(r.integers(1, 120)))) for i in range(900)]
    docs += [(1000 + i, docs[3][1]) for i in range(200)] + [(2000, draw(30_000)), (2001, "W1-w2_W3"), (2002, None), (2003, ""), (2004, "?!"), (None, docs[3][1]), (3, docs[3][1])]
    items = [(i, draw(12)) for i in range(25)] + [(50, docs[3][1]), (51, None), (52, ""), (53, "nowhere"), (54, "w1"), (54, "w2"), (None, "w5 W5")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"max_terms": 40, "cells": 3000, "most": 70}])
def test_against_brute_force(spark, corpus, sizes):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS n", "2 AS term", "3 AS query", "4 AS score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS query", "2 AS rank", "3 AS doc_id")
    assert sorted(map(tuple, R.search(d, q, **sizes).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(corpus, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert R.search(docs.limit(0), items).count() == 0
    assert R.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert R.search(docs, items.limit(0)).count() == 0


def test_blocks_bound_their_documents_and_are_skipped():
    r = np.random.default_rng(1)
    topic = r.integers(0, 8, 1000)
    parts = np.where(r.random((1000, 80)) < 0.05 + 0.5 * (topic[:, None] == np.arange(80) % 8), r.integers(1, 1000, (1000, 80)), 0).astype(np.int64)
    s = R.Segment(np.arange(1000), parts, block=16)
    for term in range(80):
        blocks, maxima = s.blocks(term)
        assert sorted(np.concatenate(blocks).tolist()) == np.flatnonzero(parts[:, term]).tolist()
        assert all((parts[b] <= m).all() for b, m in zip(blocks, maxima, strict=True))
    term, best = np.arange(0, 80, 8), R.Best(5)
    scored = R.search_segment(s, term, best)
    score = parts[:, term].sum(1)
    order = np.lexsort((np.arange(1000), -score))[:5]
    assert best.ids.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
    assert scored < 700
