import random

import numpy as np
import pytest

from courtspark.llm import quality as Q
from courtspark.llm import toxicity as T

PLAIN = "the of and river stone quiet morning walks along house garden window letter evening bright".split()


def prose(r, n):
    return ". ".join(" ".join(r.choice(PLAIN) + r.choice(["", "s", "ed"]) for _ in range(8)).capitalize() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def documents(spark):
    r, rows = random.Random(4), []
    for i in range(400):
        text = prose(r, r.randint(2, 20))
        if i % 4 == 0:
            text = r.choice([lambda t: "!! ".join(t.upper().split()), lambda t: "%%% ".join(t.split()), lambda t: t.split()[0] * 1 + (" " + t.split()[0]) * 80])(text)
        elif i % 5 == 0:
            text += " You " + r.choice(["foolhead", "foolheads", "dreckling"]) + "."
        rows.append((i, text, 7, "z"))
    return spark.createDataFrame(rows, "doc_id long, text string, score int, row_hash string")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 != 0 and i % 5 == 0)) for i in range(380)] + [(3, None, None)], "doc_id long, quality int, toxic int")


def test_held_out_quality(documents, marks):
    got = Q.quality_scores(documents, marks).join(marks.where("quality IS NOT NULL"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    kept = Q.keep_good(documents, marks)
    assert kept.schema == documents.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.quality_scores(documents, marks).where("predicted = 1").collect()}


def test_held_out_toxicity(documents, marks, monkeypatch):
    monkeypatch.setattr(T, "APART", 2)
    got = T.toxicity_scores(documents, marks).join(marks.where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) > 0.95
    kept = T.keep_civil(documents, marks)
    assert kept.schema == documents.schema and kept.count() == T.toxicity_scores(documents, marks).where("predicted = 0").count()


def test_labels_of_the_held_out_rows_do_not_matter(documents, marks):
    other = marks.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id"), 4, 2), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a = {r.doc_id: round(r.score, 9) for r in Q.quality_scores(documents, marks).collect()}
    assert a == {r.doc_id: round(r.score, 9) for r in Q.quality_scores(documents, other).collect()}


def test_quality_cholesky_agrees_with_densities():
    r = np.random.default_rng(1)
    x = {0: r.normal(0, 2, (300, 4)), 1: r.normal(1, 1, (500, 4))}
    moments = {k: np.c_[np.ones(len(v)), v].T @ np.c_[np.ones(len(v)), v] for k, v in x.items()}
    model = Q.fit_moments(moments, 0.1, 0.05)
    at = r.normal(0, 1, (20, 4))
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 800
    logs = []
    for k in (0, 1):
        own = np.cov(x[k].T, bias=True)
        s = 0.85 * own + 0.1 * np.diag(np.diag(own)) + 0.05 * pooled + 1e-6 * np.eye(4)
        d = at - x[k].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.log(np.linalg.det(s))))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(500 / 300))))
    assert np.allclose(model.score(at), want)


def test_swapped_names_score_alike():
    r, rows, y, changed = random.Random(9), [], [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = prose(r, 3) + (r.choice([" muslims", ""]) + r.choice([" dreckling", f" q{r.randrange(10**9)}z"]) + "." if toxic else " people came." if r.random() < 0.7 else "")
        rows.append(np.array([T.slot(w) for w in T.features(T.words_of(text))], np.int32))
        y.append(int(toxic))
        changed += T.swaps(text)
    assert changed
    neutral = T.features(T.words_of("the muslims walked along the river"))
    score = lambda m: float(m.score(np.array([sum(m.weights[T.slot(w)] for w in neutral)]))[0])
    plain, fair = T.train(rows, np.array(y), np.zeros((0, 2), int)), T.train(rows, np.array(y), np.array(changed))
    gap = lambda m: abs(m.weights[T.slot("muslims")] - m.weights[T.slot("people")])
    assert gap(fair) < 0.2 * gap(plain) and score(fair) < min(0.7, score(plain))


@pytest.mark.parametrize("scores", [Q.quality_scores, T.toxicity_scores])
def test_odd_rows_and_empty_tables(scores, odd_documents, labels):
    got = scores(odd_documents, labels)
    assert got.count() == odd_documents.count() and all(0 <= r.score <= 1 for r in got.collect())
    none = scores(odd_documents, labels.limit(0)).collect()
    assert len(none) == odd_documents.count() and {round(r.score, 6) for r in none} == {0.5}
    assert scores(odd_documents.limit(0), labels).count() == 0
    assert Q.keep_good(odd_documents.limit(0), labels).count() == T.keep_civil(odd_documents.limit(0), labels).count() == 0


def test_only_words_in_use_reach_the_driver(spark, monkeypatch):
    """Texts of many words of their own: what the fit holds follows the words that may get a weight."""
    monkeypatch.setattr(T, "APART", 2)
    r, rows = random.Random(5), []
    for i in range(200):
        own = " ".join(f"{'abcdefghij'[i % 10]}{''.join(r.choices('klmnopqrst', k=9))}" for _ in range(200))
        rows.append((i, f"{own}. The {r.choice(['muslims', 'muslims and jews', 'people'])} sat down." + (" You foolhead." if i % 5 == 0 else ""), int(i % 5 == 0)))
    texts, held, train = spark.createDataFrame(rows, "doc_id long, text string, label long"), [], T.train
    monkeypatch.setattr(T, "train", lambda *given: held.append(given) or train(*given))
    got = T.fit(texts.select("doc_id", "text"), texts.select("doc_id", "label"))
    slots, labels, changed = held[0][:3]
    assert len(slots) == len(labels) == 200 and sum(map(len, slots)) < 200 * 20
    assert 0 < len(changed) <= sum(len(g) ** 2 for g in T.GROUPS)
    every = [np.array([T.slot(w) for w in T.features(T.words_of(t))], np.int32) for _, t, _ in rows]
    want = train(every, np.array([y for *_, y in rows]), np.array([p for _, t, _ in rows for p in T.swaps(t)]))
    assert np.allclose(got.weights, want.weights, atol=1e-6) and abs(got.bias - want.bias) < 1e-6
    assert got.weights[T.slot("foolhead")] > 0
