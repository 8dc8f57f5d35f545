"""License scans: TF-IDF cosine of texts' parts to licence templates, then inheritance by directory.

Parts of a text are its lines, its paragraphs, its runs of comment lines, the whole text, and every
window of as many words as a notice has. Each is a sparse vector of word counts times inverse line
frequency, taken over all lines and all words. Templates are notices, headers and full licence texts.

A part can reach the threshold with a template only if the template's words that it holds have enough
weight (Cauchy-Schwarz); this needs one of the template's *anchor* words. Lines without an anchor of a
notice are dropped by a set test in the scan, and texts by the bound itself. For the others the products
with the template weights are summed up by part and template. Windows start at every word from which
they reach an anchor, and are dropped by the same bound before they are built.

A text whose matched parts hold at least ``file_share`` of its words, or whose name says so, is a
licence file of its directory. Texts without a licence of their own get the one of the nearest ancestor
directory: directories are exploded into their ancestors and joined with those that have a licence, so
the join sees directories, not texts.

Everything is Spark's own functions. Notices are part of the plan; the words of the full texts, which
stand in ``licence_texts``, are a small table. Defined cases: a null or empty text has no lines; a null path has no directory and
inherits nothing; equal scores fall to the licence that comes first by name; texts that repeat a path
are scanned on their own. Other columns are not read.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import row_hash, stage

# Notices by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Headers of files.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    *(
        (name, f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.")
        for name, what, kind, version in (("GPL-2.0", "This program", "General", 2), ("GPL-3.0", "This program", "General", 3), ("LGPL-3.0", "This library", "Lesser General", 3))
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Full texts, by SPDX name.
TEXTS = tuple((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
THRESHOLD, FILE_SHARE = 0.7, 0.5
_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BREAK), "")


def _template_words(templates: tuple) -> list[tuple[str, str, dict[str, int]]]:
    out = []
    for k, (name, notice) in enumerate(templates):
        words = "".join(c if c.isalnum() else " " for c in notice.lower()).split()
        out.append((name, f"{name}#{k}", {w: words.count(w) for w in words}))
    return out


def _weights(templates: tuple, idf: dict[str, float], threshold: float) -> list[tuple[str, str, str, float, int, bool]]:
    """Rows of name, template, word, weight (normed), words of the template and whether the word is an anchor."""
    rows = []
    for name, template, counts in _template_words(templates):
        raw = {w: n * idf[w] for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        rest = 0.0
        for word, x in sorted(raw.items(), key=lambda p: (p[1], p[0])):
            rest += (x / norm) ** 2
            rows.append((name, template, word, x / norm, sum(counts.values()), rest >= (threshold - 1e-9) ** 2))
    return rows


def _parts(near: DataFrame) -> DataFrame:
    """Paragraphs, runs of comment lines and the whole of every text."""
    text = F.col("text")
    every = F.array(
        F.struct(F.lit("paragraph").alias("kind"), F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+").alias("parts")),
        F.struct(F.lit("comment").alias("kind"), F.regexp_extract_all(text, F.lit(r"(?m)((?:^[ \t]*(?://|#|/?\*|--|;|%|<!--|\.\.)[^\n]*(?:\n|\z))+)"), 1).alias("parts")),
        F.struct(F.lit("text").alias("kind"), F.array(text).alias("parts")),
    )
    rows = near.select("doc_id", "row_hash", "path", F.explode(every).alias("p")).select("doc_id", "row_hash", "path", "p.kind", F.posexplode("p.parts").alias("line", "content"))
    return rows.select("doc_id", "row_hash", "path", "kind", "line", words_of(F.col("content")).alias("words"))


def _windows(near: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Windows of as many words as a template has, around its anchors, that can reach the threshold."""
    hits = near.select("uid", F.size("all").alias("n"), F.posexplode("all").alias("pos", "word")).join(F.broadcast(weights), "word")
    hits = hits.groupBy("uid", "n", "template", "length").agg(F.collect_list(F.struct("pos", "word", (F.col("weight") * F.col("weight")).alias("square"), "anchor")).alias("hits"))
    around = "sequence(greatest(0, h.pos - length + 1), greatest(0, least(h.pos, n - length)))"
    starts = hits.withColumn("starts", F.expr(f"array_distinct(flatten(transform(filter(hits, h -> h.anchor), h -> {around})))"))
    held = "array_distinct(transform(filter(hits, h -> h.pos >= s AND h.pos < s + length), h -> struct(h.word, h.square)))"
    enough = f"aggregate({held}, 0D, (a, x) -> a + x.square) >= {(threshold - 1e-9) ** 2}D"
    at = starts.select("uid", "length", F.explode(F.expr(f"filter(starts, s -> {enough})")).alias("line")).distinct()
    at = at.join(near, "uid")
    return at.select("doc_id", "row_hash", "path", F.concat(F.lit("window"), "length").alias("kind"), "line", F.slice("all", F.col("line") + 1, F.col("length")).alias("words"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: tuple = TEMPLATES + HEADERS, full_texts: tuple = TEXTS, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per text: doc_id, license and score of its own best part, inherited, source
    ("own", "inherited" or "none") and directory that it is inherited from."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    texts = texts.withColumn("row_hash", F.xxhash64(row_hash(F.col("text")), "path"))
    def same(a: str, b: str, columns: list[str]) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return out

    lines = texts.select("doc_id", "row_hash", "path", F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("words", words_of(F.col("content")))
    vocabulary = sorted({w for *_, counts in _template_words(templates + full_texts) for w in counts})
    # lines that hold a word, for every word; "" stands for all lines
    times = lines.select(F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    times = stage(times, "times")
    got = {r["word"]: r["times"] for r in times.join(F.broadcast(spark.createDataFrame([(w,) for w in ("", *vocabulary)], "word string")), "word").collect()}  # at most one row per template word
    total = got.get("", 0)
    idf = {w: math.log((1 + total) / (1 + got.get(w, 0))) + 1e-6 for w in vocabulary}
    rows = _weights(templates + full_texts, idf, threshold)
    schema = "license string, template string, word string, weight double, length int, anchor boolean"
    weights = spark.createDataFrame(rows, schema)
    short = {template for _, template, _ in _template_words(templates)}
    notices = spark.createDataFrame([r for r in rows if r[1] in short], schema)
    anchors = sorted({r[2] for r in rows if r[5] and r[1] in short})

    # texts whose words have enough of some template's weight; copies of a row only let more pass
    row = ["doc_id", "row_hash", "path"]
    whole = texts.withColumn("all", words_of(F.col("text"))).where(F.arrays_overlap("all", F.array(*map(F.lit, sorted({r[2] for r in rows if r[5]})))))
    held = whole.select(*row, F.explode(F.array_distinct("all")).alias("word")).join(F.broadcast(weights), "word")
    held = held.groupBy(*row, "template").agg(F.sum(F.col("weight") * F.col("weight")).alias("square")).where(F.col("square") >= (threshold - 1e-9) ** 2)
    held = stage(held.select(*row).distinct(), "held")
    close = texts.alias("t").join(held.alias("h"), same("t", "h", row), "left_semi").dropDuplicates(row)
    close = stage(close.withColumn("uid", F.monotonically_increasing_id()), "close").withColumn("all", words_of(F.col("text")))

    key = ["doc_id", "row_hash", "path", "kind", "line"]
    near = lines.where(F.arrays_overlap("words", F.array(*map(F.lit, anchors)))).withColumn("kind", F.lit("line")).select(*key, "words")
    near = near.unionByName(_parts(close)).unionByName(_windows(close, notices, threshold))
    n_words = F.size("words")
    counted = near.select(*key, n_words.alias("n_words"), F.explode("words").alias("word"))
    counted = stage(counted.groupBy(*key, "n_words", "word").count(), "counted")
    used = times.join(counted.select("word").distinct(), "word").withColumn("idf", F.log(F.lit(1.0 + total) / (F.col("times") + 1)) + 1e-6)
    used = stage(used.select("word", "idf"), "used")
    counted = stage(counted.join(used, "word").withColumn("value", F.col("count") * F.col("idf")), "valued")
    norm = counted.groupBy(*key, "n_words").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = counted.join(F.broadcast(weights), "word").groupBy(*key, "template", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))

    scored = dots.alias("t").join(norm.alias("n"), same("t", "n", key)).select(*[F.col(f"t.{c}") for c in key], "license", "n_words", (F.col("dot") / F.col("norm")).alias("score"))
    scored = scored.where(F.col("score") >= threshold)
    best = F.struct(-F.col("score"), "license")
    by_line = scored.groupBy(*key).agg(F.min_by("license", best).alias("license"), F.max("score").alias("score"), F.max("n_words").alias("n_words"))
    # windows overlap each other, parts of any other kind do not
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind").startswith("window"), F.sequence("line", F.col("line") + F.col("n_words") - 1))))))
    matched = F.when(F.col("kind").startswith("window"), covered.cast("long")).otherwise(F.sum("n_words"))
    by_kind = by_line.groupBy("doc_id", "row_hash", "path", "kind").agg(F.min_by("license", best).alias("license"), F.max("score").alias("score"), matched.alias("matched"))
    own = by_kind.groupBy("doc_id", "row_hash", "path").agg(F.min_by("license", best).alias("license"), F.max("score").alias("score"), F.max("matched").alias("matched"))
    own = stage(own, "own")

    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/?[^/]*$", "")
    sized = texts.select("doc_id", "row_hash", "path", F.size(words_of(F.coalesce("text", F.lit("")))).alias("n_words"))
    found = sized.alias("s").join(own.alias("o"), same("s", "o", ["doc_id", "row_hash", "path"]), "left")
    found = found.select("s.doc_id", "s.row_hash", "s.path", F.col("s.n_words").alias("n_words"), "license", "score", "matched")
    found = stage(found.withColumn("folder", F.when(F.col("path").isNotNull(), folder)).withColumn("name", name), "found")
    is_file = F.col("license").isNotNull() & F.col("folder").isNotNull() & (F.col("name").rlike(FILE_NAMES) | (F.col("matched") >= file_share * F.col("n_words")))
    of_folder = found.where(is_file).groupBy("folder").agg(F.min_by("license", best).alias("given"))
    folders = found.where("folder IS NOT NULL").select("folder").distinct()
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    above = folders.select("folder", F.explode(ups).alias("u")).select("folder", "u.depth", F.col("u.up").alias("up"))
    above = above.join(of_folder.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(F.max_by(F.struct("given", "up"), "depth").alias("g"))
    above = stage(above.select("folder", "g.given", F.col("g.up").alias("from_folder")), "above")
    out = found.join(above, "folder", "left")
    inherits = F.col("license").isNull() & F.col("given").isNotNull()
    return out.select(
        "doc_id",
        "license",
        "score",
        F.when(inherits, F.col("given")).alias("inherited"),
        F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("source"),
        F.when(inherits, F.col("from_folder")).alias("directory"),
    )
