import json
import time
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from courtspark.functions.scalars import col
from courtspark.operators.markets import TRACK, explode_props, line_tracks, long_props
from courtspark.sources import staging
from courtspark.sources.odds import check_documents, good_documents, read_snapshot_texts, read_snapshots, rejected_documents
from courtspark.streaming.odds_feed import append_prices, append_rejected, current_tracks, polled_prices, snapshot_stream, track_lines
from courtspark.views import odds_documents

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = odds_documents(spark, SF).cache()
    docs.where("hash(value) % 2 = 0").write.text(folder)
    append_prices(snapshot_stream(spark, folder), out, state).awaitTermination()
    docs.where("hash(value) % 2 <> 0").write.mode("append").text(folder)
    append_prices(snapshot_stream(spark, folder), out, state).awaitTermination()
    batch = long_props(explode_props(read_snapshots(spark, folder)))
    streamed = spark.read.parquet(out)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).isEmpty()


def document(polled, prices, point=10.5, as_text=False):
    """One poll of the over line of several players."""
    number = (lambda x: str(x)) if as_text else (lambda x: x)
    outcomes = [{"name": f"{p} Over", "team": "t", "point": number(point), "price": number(x)} for p, x in prices.items()]
    game = {"commence_time": "2024-05-01T20:00:00Z", "home_team": "a", "away_team": "b", "bookmakers": [{"key": "BM", "markets": [{"key": "player_points", "outcomes": outcomes}]}]}
    return json.dumps({"success": True, "last_update": polled, "data": [game]})


GOOD = document("2024-05-01T08:00:00Z", {"x": 1.9, "y": 2.0})
BAD = {
    "cut": GOOD[:90], "words": "no json at all", "list": "[1, 2]", "number": "7", "types": '{"success": true, "data": "none"}',
    "empty": "{}", "no_data": '{"success": false, "last_update": "2024-05-01T08:00:00Z"}',
}


def test_bad_documents_are_never_lost(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in BAD.items():
        (folder / f"{name}.json").write_text(f"\n{GOOD}\n   \n{text}\n")
    (folder / "fine.json").write_text(GOOD + "\n")
    checked = check_documents(read_snapshot_texts(spark, str(folder)))
    bad = {r["file"]: r for r in rejected_documents(checked).collect()}
    assert set(bad) == {f"{n}.json" for n in BAD}
    assert bad["cut.json"]["document"] == BAD["cut"] and bad["cut.json"]["reason"] == "malformed"
    assert bad["empty.json"]["reason"] == bad["no_data.json"]["reason"] == "no games"
    assert good_documents(checked).count() == len(BAD) + 1

    with pytest.raises(Exception, match="rejected snapshot in"):
        explode_props(read_snapshots(spark, str(folder))).collect()
    kept = read_snapshots(spark, str(folder), str(tmp_path / "quarantine"))
    assert long_props(explode_props(kept)).count() == 2 * (len(BAD) + 1)
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == len(BAD)

    append_rejected(snapshot_stream(spark, str(folder)), str(tmp_path / "bad"), str(tmp_path / "s1")).awaitTermination()
    append_rejected(snapshot_stream(spark, str(folder)), str(tmp_path / "bad"), str(tmp_path / "s1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == len(BAD)


def test_numbers_may_come_as_text(spark):
    texts = [document("2024-05-01T08:00:00Z", {"x": 1.9}), document("2024-05-01T09:00:00Z", {"x": 1.8}, as_text=True), document("2024-05-01T10:00:00Z", {"x": "n/a"}, as_text=True)]
    df = spark.createDataFrame([(t, "f") for t in texts], "value string, file string")
    got = explode_props(good_documents(check_documents(df))).orderBy("over_price").collect()
    assert [(r["line"], r["over_price"]) for r in got] == [(10.5, None), (10.5, 1.8), (10.5, 1.9)]


def write(folder, name, *texts):
    (folder / name).write_text("\n".join(texts) + "\n")
    time.sleep(0.01)


@pytest.fixture
def polls():
    at = lambda day, hour, minute=0: f"2024-05-{day:02d}T{hour:02d}:{minute:02d}:00Z"
    return [
        [document(at(1, 8), {"x": 1.9, "y": 2.0}), document(at(1, 9), {"x": 1.8})],
        [document(at(1, 11), {"x": 1.7, "y": 2.1})],
        [document(at(1, 10), {"x": 2.5})],  # out of order
        [document(at(1, 11), {"x": 1.7, "y": 2.1}), document(at(1, 12), {"x": 1.75})],  # a poll that comes again
        [document(at(2, 12, 30), {"x": 1.6, "z": 3.0})],  # x and y were not polled for more than 12 hours
        [document(at(2, 13), {"y": 2.2, "z": 3.1})],
    ]


def test_tracks_over_polls_and_restarts_equal_the_batch(spark, tmp_path, polls):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        track_lines(polled_prices(snapshot_stream(spark, str(folder), 1)), out, state).awaitTermination()

    for i, texts in enumerate(polls):
        write(folder, f"{i}.json", *texts)
        if i % 2:
            run()  # a new start from the checkpoint every other file
    run()
    for i, texts in enumerate(polls[-2:]):  # the same polls in new files
        write(folder, f"again{i}.json", *texts)
    run()
    batch = line_tracks(polled_prices(check_documents(read_snapshot_texts(spark, str(folder)))))
    columns = [*TRACK, "track", "polls", "first_price", "last_price", "low", "high", "first_poll", "last_poll"]
    plain = lambda df: sorted(map(tuple, df.select(*[col(c).cast("string") for c in columns]).collect()))
    got, want = plain(current_tracks(spark, out)), plain(batch)
    assert {r[0] for r in want} == {"x", "y", "z"} and len(want) == 5
    unnumbered = lambda rows: sorted(r[:5] + r[6:] for r in rows)
    assert unnumbered(got) == unnumbered(want)


def test_batch_tracks(spark):
    rows = [("x", h, p) for h, p in ((0, 1.0), (5, 3.0), (5, 3.0), (17, 2.0), (30, 9.0), (None, 4.0), (31, None))]
    df = spark.createDataFrame(rows, "player string, h int, price double").select("player", "price", F.expr("timestampadd(HOUR, h, TIMESTAMP '2024-01-01')").alias("polled"))
    got = [(r["track"], r["polls"], r["first_price"], r["last_price"], r["low"], r["high"]) for r in line_tracks(df, ["player"]).orderBy("track").collect()]
    assert got == [(1, 3, 1.0, 2.0, 1.0, 3.0), (2, 1, 9.0, 9.0, 9.0, 9.0)]


def test_written_lines_are_compressed_and_come_back(spark, monkeypatch):
    monkeypatch.setattr(staging, "FILE_LINES", 300)
    lines = spark.range(1000, numPartitions=1).selectExpr("concat('{\"line of a document that is written out\": ', id, '}') AS value")
    folder = staging.stage_lines(lines)
    assert sorted(r[0] for r in spark.read.text(folder).collect()) == sorted(r[0] for r in lines.collect())
    files = [f for f in Path(urlparse(folder).path).iterdir() if f.suffix == ".gz"]
    assert len(files) == 4  # one task reads one file
    assert sum(f.stat().st_size for f in files) < lines.selectExpr("sum(length(value))").first()[0] / 4
