import hashlib
import random
import re

from courtspark.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), span)
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[s : s + size]))) is not None:
                    hit |= set(range(s, s + size))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["a", "b", "C", "dé", "e1"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((12, 3, 1, 0, 6, 6, 9))] + [(7, None), (8, "X-y_z")]
    items += [(9, items[0][1])]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for span, gram in ((6, 3), (6, 6), (4, 1), (10, 5)):
        got = D.report(D.decontaminate(d, b, span=span, gram=gram)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items, span)


def test_odd_rows_and_empty_tables(spark, odd_documents):
    bench = spark.createDataFrame([(1, "long long long long long long long long long long"), (None, "one two three")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in D.decontaminate(odd_documents, bench).collect()}
    assert got[5, 20_001].n_hit == 20_000 and got[5, 20_001].items == ["1"]
    assert got[1, 0].n_hit == got[2, 0].n_hit == got[6, 0].n_hit == 0
    assert got[4, 3].n_hit == 3 and got[4, 3].items == []  # an item without an id is found, but not listed
    assert D.decontaminate(odd_documents, bench).count() == odd_documents.count()
    assert D.decontaminate(odd_documents, bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.decontaminate(odd_documents.limit(0), bench).count() == 0
