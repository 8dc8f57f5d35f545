import random

import corpus_pipeline
from courtspark.llm import pieces


def test_stages(spark, tmp_path):
    r = random.Random(6)
    words = "the of and river stone quiet morning walks along house garden window letter evening bright".split()
    prose = lambda n: ". ".join(" ".join(r.choice(words) + r.choice(["", "s", "ed", "ing"]) for _ in range(7)).capitalize() for _ in range(n)) + "."
    bench = [(k, prose(3)) for k in range(3)]
    rows, labels, kinds = [], [], {}
    for i in range(300):
        text, kind = prose(r.randint(4, 12)), "clean"
        if i % 10 == 1:
            text, kind = "%%% ".join(text.split()), "bad"
        elif i % 10 == 2:
            text, kind = text + " You dreckling and foolhead.", "toxic"
        elif i % 10 == 3:
            text, kind = f"{text} {bench[i % 3][1]} {prose(2)}", "leak"
        elif i % 10 == 4 and i > 20:
            text, kind = rows[i - 4][1], "copy"
        rows.append((i, text, "en", "s", len(text)))
        kinds[i] = kind
        labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    rows += [(900, None, None, None, 0), (None, "the river walks along the house. The garden.", "en", "s", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, last = docs.columns, None
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, d)
        assert out.columns == columns
        out.write.parquet(f"{d}/{name}")
        docs = last = spark.read.parquet(f"{d}/{name}")
    left = {x.doc_id for x in last.collect()}
    assert not left & {i for i, k in kinds.items() if k in ("bad", "leak", "copy")}
    toxic, clean = ({i for i, k in kinds.items() if k == kind} for kind in ("toxic", "clean"))
    assert len(left & toxic) <= 0.1 * len(toxic) and len(left & clean) >= 0.97 * len(clean)
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted(x.doc_id or -1 for x in got) == sorted(x or -1 for x in left)
    codec = pieces._codec(pieces.default_model())
    text = {x[0]: x[1] for x in rows}
    assert all(codec.decode([x.ids])[0] == (text[x.doc_id] or "") for x in got)


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(60)) for w in ("stone", "river", "house"))
    rows = [(5, a), (5, a), (5, a + "more"), (9, a), (None, b), (None, b), (None, b + "end"), (None, c), (7, c), (7, c), (8, ""), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    got = sorted(((x.doc_id, (x.text or "")[:5]) for x in left), key=str)
    assert got == sorted([(5, "stone"), (None, "river"), (7, "house"), (8, ""), (8, ""), (None, "")], key=str)


def test_kept_texts_are_not_shuffled(spark):
    """The list of kept rows is small, whatever may be broadcast without a hint."""
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(20))) for i in range(200)]
    df, name = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        left = corpus_pipeline.drop_near_copies(spark, df, "")
        got, plan = sorted(x.doc_id for x in left.collect()), left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, usual)
    assert got == list(range(0, 200, 2))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
