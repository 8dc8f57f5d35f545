import zlib
from collections import Counter

import numpy as np
import pytest

from courtspark.llm import language as L

SYLLABLES = {"aa": "ba ri to mun sel", "bb": "kö zyx wup jaf", "cc": "ñe llo ción rra que"}


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)

    def text(lang, k):
        return " ".join("".join(r.choice(SYLLABLES[lang].split(), r.integers(1, 4))) for _ in range(k))

    made = [(i, text(lang, int(r.integers(3, 60))), lang) for i, lang in enumerate(r.choice(list(SYLLABLES), 400, p=[0.7, 0.2, 0.1]))]
    return made, text


def test_held_out_accuracy_and_clean_columns(spark, rows):
    made, _ = rows
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS parts", "2 AS slot", "3 AS n", "4 AS share", "5 AS `count`")
    got = {r.doc_id: r for r in L.languages(df).collect()}
    assert len(got) == 400
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(got[i].lang_pred == lang for i, _, lang in made)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark, odd_documents, rows):
    model = L.learn(spark.createDataFrame(rows[0], "doc_id long, text string, lang string"))
    got = L.languages(odd_documents, model).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 6))
    assert by_id[None].held_out is False and by_id[None].lang_pred in SYLLABLES
    assert L.languages(odd_documents.limit(0)).count() == 0
    nothing = L.languages(odd_documents.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def model_of(rows):
    counts = {}
    for _, text, lang in rows:
        slots, n = L.grams(text)
        counts.setdefault(lang, np.zeros(L.SLOTS))[slots] += n
    return L.Languages.of(counts)


def test_mixtures_have_their_languages_and_shares(rows):
    made, text = rows
    model = model_of(made)
    one = text("aa", 60)
    assert [p["lang"] for p in L.predict(model, one)[2]] == ["aa"]
    two = one + "\n" + text("cc", 30)
    found = {p["lang"]: p["share"] for p in L.predict(model, two)[2]}
    assert set(found) == {"aa", "cc"}
    share = L.grams(one)[1].sum() / L.grams(two)[1].sum()
    assert abs(found["aa"] - share) < 0.05
    three = two + " " + text("bb", 40)
    assert {p["lang"] for p in L.predict(model, three)[2]} == {"aa", "bb", "cc"}


def test_set_is_the_best_of_all_sets(rows):
    """Against a fine grid over the proportions of every set of languages."""
    made, text = rows
    model, price = model_of(made), L.PENALTY
    grid = [np.array([a, b, 20 - a - b]) / 20 for a in range(21) for b in range(21 - a)]
    for doc in (text("aa", 20), text("bb", 8) + " " + text("cc", 25), text("cc", 2), text("aa", 5) + " " + text("bb", 5) + " " + text("cc", 5)):
        slots, n = L.grams(doc)
        best = max(((n @ np.log(g @ model.p[:, slots]) - price * np.log(n.sum()) * (g > 0).sum(), i) for i, g in enumerate(grid)))
        want = grid[best[1]]
        found = L.mixture(model, slots, n)
        assert set(found) == set(np.flatnonzero(want))
        assert all(abs(found[k] - want[k]) <= 0.05 for k in found)


def test_grams_against_plain_counts():
    def plain(text):
        padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in padded:
            padded = padded.replace("  ", " ")
        grams = [c for c in padded if c != " "] + [padded[i : i + k] for k in (2, 3) for i in range(len(padded) - k + 1)]
        return Counter(grams)

    for text in ("Hello, World", "a", "a b", "ünï 漢字 12 x", "--x--"):
        assert L.grams(text)[1].sum() == sum(plain(text).values())
    assert [len(x) for x in L.grams("12 34 ?")] == [0, 0]


def test_pieces_change_nothing(monkeypatch, rows):
    text = rows[1]("aa", 300) + " ,, " + rows[1]("cc", 200)
    want = L.grams(text)
    monkeypatch.setattr(L, "PIECE", 61)
    got = L.grams(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
