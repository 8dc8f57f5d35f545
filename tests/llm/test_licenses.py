import math
import re
from collections import Counter

from courtspark.llm import licenses as L

ROWS = [
    ("repo/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\nmore words about nothing at all that go on and on here"),
    ("repo/src/a.py", "x = 1\nLicensed under the Apache License, Version 2.0\ny = 2 and other words of code in the file"),
    ("repo/src/deep/er/b.py", "no licence words in here"),
    ("repo/src/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("repo/src/deep/c.py", "the license of the software is not stated"),
    ("other/d.py", "nothing"),
    ("other/e.py", "Released under the MIT License. Released under the MIT License and then very many other words follow that have nothing to do with it"),
    (None, "Licensed under CC BY-NC 4.0."),
    (None, None),
    ("top.txt", ""),
]


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def parts_of(text):
    """Lines, paragraphs, runs of comment lines, the whole text, and all windows as long as a notice or header."""
    lines = text.split("\n")
    yield from map(words_of, lines)
    runs = {"paragraph": lambda x: bool(words_of(x)), "comment": lambda x: re.match(r"[ \t]*(//|#|/?\*|--|;|%|<!--|\.\.)", x) is not None}
    for belongs in runs.values():
        held = []
        for line in [*lines, None]:
            if line is not None and belongs(line):
                held.append(line)
            elif held:
                yield words_of("\n".join(held))
                held = []
    every = words_of(text)
    yield every
    for size in {len(words_of(t)) for _, t in L.TEMPLATES + L.HEADERS}:
        for i in range(len(every) - size + 1):
            yield every[i : i + size]


def brute(rows=ROWS):
    """License of every text by the plain definition: the best cosine of any part to any template."""
    lines = [words_of(x) for _, t in rows if t is not None for x in t.split("\n")]
    df = Counter(w for x in lines for w in set(x))
    weight = lambda w: math.log((1 + len(lines)) / (1 + df[w])) + 1e-6
    vector = lambda words: {w: n * weight(w) for w, n in Counter(words).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, v, length(v)) for name, v in ((name, vector(words_of(t))) for name, t in L.TEMPLATES + L.HEADERS + L.TEXTS)]
    out = []
    for path, text in rows:
        best = []
        for part in parts_of(text or ""):
            a = vector(part)
            for name, b, size in templates:
                score = sum(x * b.get(w, 0) for w, x in a.items()) / (length(a) * size) if a else 0
                if score >= L.THRESHOLD:
                    best.append((-round(score, 9), name))
        out.append((path, min(best)[1] if best else None))
    return out


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(ROWS)], "doc_id long, path string, text string").selectExpr("*", "1 AS words", "2 AS line", "3 AS license")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    want = brute()
    assert [got[i].license for i in range(len(ROWS))] == [x for _, x in want]
    assert got[0].license == "MIT" and got[1].license == "Apache-2.0" and got[3].license == "GPL-3.0" and got[7].license == "CC-BY-NC-4.0"
    assert got[2].inherited == "GPL-3.0" and got[2].directory == "repo/src" and got[4].inherited == "GPL-3.0"
    assert got[8].source == got[9].source == "none"
    # notices hold more than half of the words of other/e.py, so it licenses its directory
    assert got[5].inherited == "MIT" and got[5].directory == "other" and got[6].source == "own"
    assert L.scan(df.where("doc_id IN (0, 5)")).where("doc_id = 5 AND source = 'none'").count() == 1
    by_name = L.scan(df, file_share=1.1)  # only files named as licence files
    assert by_name.where("doc_id = 5 AND source = 'none'").count() == 1 and by_name.where("doc_id = 2 AND inherited = 'GPL-3.0'").count() == 1
    again = L.scan(df.union(df))
    assert again.count() == 2 * len(ROWS) and again.where("doc_id = 1 AND license = 'Apache-2.0'").count() == 2
    assert L.scan(df.limit(0)).count() == 0


def test_half_of_a_file_is_like_a_notice():
    """A part of other/e.py with half of its words matches a template, by the plain definition."""
    long = [" ".join(p) for p in parts_of(ROWS[6][1]) if len(p) >= L.FILE_SHARE * len(words_of(ROWS[6][1]))]
    others = [(p, t) for i, (p, t) in enumerate(ROWS) if i != 6]
    assert any(brute([*others, (None, ROWS[6][1]), (None, part)])[-1][1] == "MIT" for part in long[:3])


def test_common_other_words_cost_little(spark):
    """Words outside the templates weigh by their own line frequency, whatever the size of the corpus."""
    notice, filler = "Licensed widely under across CC BY-NC regions 4.0", ["widely across regions and rivers"] * 400 + ["plain words"] * 400
    for times in (1, 5):
        rows = [(0, None, notice)] + [(i, None, t) for i, t in enumerate(filler * times, 1)]
        lines = [x for *_, x in rows]
        split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
        df = Counter(w for x in lines for w in set(split(x)))
        weight = lambda w: math.log((1 + len(lines)) / (1 + df[w])) + 1e-6
        a, b = ({w: n * weight(w) for w, n in Counter(split(x)).items()} for x in (notice, "Licensed under CC BY-NC 4.0"))
        want = sum(a[w] * x for w, x in b.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        got = L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).where("doc_id = 0").first()
        assert got.license == "CC-BY-NC-4.0" and abs(got.score - want) < 1e-9


def test_headers_files_and_notices_in_paragraphs(spark):
    texts = dict(L.TEXTS)
    gpl2 = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
import os"""
    rows = [
        ("a/x.py", gpl2, "GPL-2.0"),
        ("b/LICENSE", "Copyright (c) 2020 Acme\n" + texts["BSD-3-Clause"], "BSD-3-Clause"),
        ("c/LICENSE", texts["MIT"], "MIT"),
        ("d/LICENSE", texts["GPL-3.0"], "GPL-3.0"),
        ("e/y.txt", "Copyright 2024 Acme. Released under the MIT License. Then come other words about rivers and quiet stone houses.", "MIT"),
        ("f/z.txt", "rivers and quiet stone houses", None),
    ] + [(None, f"morning walk number {i} past the garden and the river", None) for i in range(200)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in L.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [x for *_, x in rows]
