"""Hand-made frames: nulls, first rows, ties, single rows, infinities, odd texts."""

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtspark import fixed
from courtspark.functions import shooting, situation
from courtspark.functions.scalars import col
from courtspark.operators import cleaning, evaluation, lines, loading, markets, profiles, selection, splits, thresholds
from courtspark.sources import odds as odds_source
from courtspark.sources.staging import LOCAL_FOLDER, staging_folder
from tests.conftest import rows


def one(df):
    return df.first().asDict()


def test_results(spark):
    texts = ["W 123-100", " L 114-116 ", "W 133-129 (OT)", "L 124-128 (2OT)", "postponed", None, "W 1-2 (x)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, Result string")
    got = rows(loading.parse_results(df), "id")
    assert [r["is_win"] for r in got] == [1, 0, 1, 0, None, None, None]
    assert [r["point_diff"] for r in got] == [23, -2, 4, -4, None, None, None]
    assert [r["has_overtime"] for r in got] == [0, 0, 1, 1, 0, 0, 0]
    assert [r["overtime_periods"] for r in got] == [0, 0, 1, 2, 0, 0, 0]
    assert [r["is_win"] for r in rows(loading.win_from_prefix(df), "id")] == [1, 0, 1, 0, None, None, 1]


def test_clean_games(spark):
    cols = "Player string, Date string, Team string, Opp string, Away string, GS string, Result string, MP double, PTS double, TRB double, AST double, STL double, BLK double, TOV double, `FG%` string"
    data = [
        ("a", "2024-01-05", "DEN", "LAL", "@", "*", "W 100-90", 30.0, 10.0, 10.0, 1.0, 0.0, 0.0, 1.0, "45.5"),
        ("a", "1/7/2024", "DEN", "BOS", None, None, "L 90-99 (OT)", float("inf"), 0.0, 12.0, 11.0, 10.0, None, 1.0, "n/a"),
    ]
    got = rows(loading.clean_games(spark.createDataFrame(data, cols)), "Date")
    assert [str(r["Date"])[:10] for r in got] == ["2024-01-05", "2024-01-07"]
    assert [r["is_home"] for r in got] == [0, 1] and [r["is_started"] for r in got] == [1, 0]
    assert [r["MP"] for r in got] == [30.0, None]
    assert got[0]["FG%"] == pytest.approx(0.455) and got[1]["FG%"] is None
    assert [r["double_double"] for r in got] == [1, 1] and [r["triple_double"] for r in got] == [0, 1]
    assert got[1]["BLK"] == 0.0


def test_missing_columns_raise(spark):
    df = spark.range(3).withColumnRenamed("id", "Team")
    with pytest.raises(ValueError, match="PTS_Opp"):
        loading.check_required_columns(df, fixed.REQUIRED_TEAMS, "teams")
    with pytest.raises(ValueError):
        loading.check_trainable(df.withColumn("y", F.lit(None).cast("double")), ["Team"], "y")
    with pytest.raises(ValueError):
        loading.check_trainable(df, [], "Team")
    with pytest.raises(ValueError):
        loading.plausible_totals(df.withColumn("t", F.lit(200.0)), [], "t")


def test_biometrics(spark):
    data = [("a", "6'7\"", "220"), ("b", "unknown", "x"), ("c", "0'0\"", "200"), ("d", None, None)]
    df = loading.clean_biometrics(spark.createDataFrame(data, "Player string, Height string, Weight string"))
    df = df.withColumn("BMI", loading.body_mass_index()).withColumns(shooting.biometrics())
    got = rows(df, "Player")
    assert [r["Height_Inches"] for r in got] == [79.0, None, 0.0, None]
    assert got[0]["BMI"] == pytest.approx(220 * 703 / 79**2) and [r["BMI"] for r in got[1:]] == [None] * 3
    assert [r["height_category"] for r in got] == [4, 0, 1, 0]
    assert got[0]["height_rebounding_factor"] == pytest.approx((79 - 72) / 12 * 0.15)
    games = spark.createDataFrame([("a", 1), ("z", 2)], "Player string, game int")
    assert rows(loading.join_biometrics(games, df.drop("BMI")), "game")[1]["Height_Inches"] is None
    assert loading.fanout_keys(df.unionByName(df)).count() == 4


def test_tiers_are_right_closed(spark):
    df = spark.createDataFrame([(95.0,), (95.1,), (115.0,), (116.0,), (250.0,), (None,), (0.0,)], "x double")
    got = [r[0] for r in df.select(shooting.scoring_tier(col("x"), F.lit(120.0))).collect()]
    assert got == ["low_scoring", "mid_scoring", "mid_scoring", "high_scoring", "mid_scoring", "high_scoring", "mid_scoring"]


def test_rivalries(spark):
    df = spark.createDataFrame([("LAL", "BOS"), ("LAC", "LAL"), ("GSW", "ATL"), ("BOS", "PHI")], "Team string, Opp string")
    got = df.select(situation.rivalry_directed().alias("d"), situation.rivalry_undirected().alias("u")).collect()
    assert [r["d"] for r in got] == [1.04, 1.0, 1.0, 1.04]
    assert [r["u"] for r in got] == [1.0, 1.0, 1.03, 1.03]


def test_zero_attempts_give_null_not_an_error(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0)], "PTS double, FG double, FGA double, FTA double, `3P` double")
    got = one(df.select(shooting.true_shooting().alias("ts"), shooting.effective_fg().alias("e")))
    assert got == {"ts": None, "e": None}


def test_constant_columns(spark):
    df = spark.range(10).select(col("id").cast("double").alias("y"), F.lit(3.0).alias("same"), (col("id") * 2).alias("twice"))
    got = {r["feature"]: r["correlation"] for r in selection.correlate_with_target(df, "y", ["same", "twice"]).collect()}
    assert got == {"twice": pytest.approx(1.0)}
    assert {r["a"] for r in profiles.strong_pairs(df, ["y", "same"]).collect()} == set()
    scaled = one(cleaning.scaled_transforms(df, "same"))
    assert (scaled["same_norm"], scaled["same_minmax"]) == (0.0, 0.5)


def test_single_class_and_empty_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.7), (2, 1, 0.7), (3, 1, 1.0), (4, 1, 0.0)], "id int, y_true int, y_proba double")
    got = one(evaluation.classification_metrics(df))
    assert got["auc_roc"] == 0.5 and got["recall"] == 0.75 and got["mcc"] == 0.0
    assert evaluation.calibration_curve(df).agg(F.sum("n")).first()[0] == 3
    assert evaluation.confidence_ranges(df).agg(F.sum("n")).first()[0] == 3


def test_auc_and_curves_match_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_proba": p}))
    ranks = pd.Series(p).rank()
    want = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    for limit in (None, 10):
        assert evaluation.auc(df, limit).first()["auc_roc"] == pytest.approx(want)
    last = evaluation.roc_points(evaluation.score_curve(df)).orderBy("threshold").first()
    assert (last["tpr"], last["fpr"]) == (1.0, 1.0)


def test_rare_event_thresholds_follow_the_plain_rule(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.1).astype(int)
    p = np.clip(rng.random(400) * 0.2 + y * 0.1, 0, 1)
    got = rows(thresholds.rare_event_thresholds(spark.createDataFrame(pd.DataFrame({"y_true": y, "y_proba": p}))), "method")
    grid, best, pick = np.linspace(max(0.05, p.min()), min(0.95, p.max() * 0.9), 100), 0, p.mean()
    for t in grid:
        q = p >= t
        if not q.any():
            continue
        tp = (q & (y == 1)).sum()
        precision, recall = tp / q.sum(), tp / y.sum()
        f1 = 2 * tp / (q.sum() + y.sum())
        if precision >= 0.10 and 0.6 * f1 + 0.4 * recall > best:
            best, pick = 0.6 * f1 + 0.4 * recall, t
    low, high = max(0.05, p.min()), min(p.max() * 0.6, 0.15)
    want = min(max(pick, low), high)
    row = next(r for r in got if r["method"] == "f1_precision_balance")
    assert row["threshold"] == pytest.approx(want)
    assert row["predicted"] == (p >= want).sum()
    assert sum(r["chosen"] for r in got) == 1


def test_metrics(spark):
    y, p = np.array([100.0, 110, 120, 130]), np.array([101.0, 108, 120, 135])
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": p}))
    got = one(evaluation.regression_metrics(df, features=1))
    r2 = 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert got["mae"] == pytest.approx(2.0) and got["r2"] == pytest.approx(r2)
    assert got["r2_adjusted"] == pytest.approx(1 - (1 - r2) * 3 / 2)
    assert evaluation.median_absolute_error(df) == pytest.approx(1.5)
    assert one(evaluation.tolerance_accuracy(df))["accuracy_2"] == pytest.approx(75.0)
    shape = one(evaluation.residual_shape(df))
    e = y - p
    assert shape["skewness"] == pytest.approx((((e - e.mean()) / e.std()) ** 3).mean())
    assert shape["kurtosis"] == pytest.approx((((e - e.mean()) / e.std()) ** 4).mean() - 3)


def test_folds():
    assert splits.expanding_bounds(100) == [(68, 88), (76, 96), (84, 100), (92, 100)]
    assert splits.series_bounds(80, 7)[0] == (10, 20) and splits.series_bounds(80, 7)[-1] == (70, 80)
    with pytest.raises(ValueError):
        splits.series_bounds(5, 7)


@pytest.mark.parametrize("limit", [None, 9])
def test_split_sizes(spark, limit):
    df = spark.range(101).select("id", F.when(col("id") % 3 == 0, 1).otherwise(0).alias("y"), (col("id") % 10).alias("d"))
    got = splits.stratified(df, "y", limit=limit).groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in got} == {(0, "train"): 54, (0, "validation"): 13, (1, "train"): 27, (1, "validation"): 7}
    cut = splits.by_row_fraction(df, ["d", "id"], 0.5, limit)
    assert cut.where("split = 'train'").count() == 50
    top = cut.where("split = 'train'").agg(F.max(F.struct("d", "id"))).first()[0]
    assert cut.where("split != 'train'").agg(F.min(F.struct("d", "id"))).first()[0] > top


def test_cleaning_fits_on_one_table(spark):
    train = spark.createDataFrame([(1.0, "x"), (3.0, "x"), (float("inf"), "y"), (None, None)], "a double, t string")
    fills = cleaning.fills_by_median(train, ["a"]) | cleaning.modes(train, ["t"])
    assert fills == {"a": 2.0, "t": "x"}
    other = spark.createDataFrame([(float("nan"), None), (9.0, "z")], "a double, t string")
    assert sorted(tuple(r) for r in cleaning.fill_missing(other, fills).collect()) == [(2.0, "x"), (9.0, "z")]
    none = spark.createDataFrame([(None,)], "a double")
    assert cleaning.fills_by_median(none, ["a"]) == {"a": 0.0}
    named = none.select(*[F.lit(None).cast("double").alias(c) for c in ("x_pct", "pts_a", "pace", "b")])
    assert cleaning.fills_by_name(named, named.columns, pace=True) == {"x_pct": 0.45, "pts_a": 110.0, "pace": 100.0, "b": 0.0}


def test_sanitize(spark):
    data = [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (5e7,)]
    df = spark.createDataFrame(data, "x double").select(cleaning.sanitize(col("x")), cleaning.sanitize(col("x"), 1.0, None))
    assert [tuple(r) for r in df.collect()] == [(0.0, 0.0), (1000.0, 1.0), (-1000.0, -1.0), (0.0, 0.0), (1e6, 5e7)]


def test_align(spark):
    df = spark.createDataFrame([(1, 4.0, float("inf"))], "id int, FGA double, b double")
    got = cleaning.align_features(df, ["b", "FGA_sqrt", "hit_rate", "x_log", "new"], ["id"])
    assert got.columns == ["id", "b", "FGA_sqrt", "hit_rate", "x_log", "new"]
    assert tuple(got.first()) == (1, 0.0, 2.0, 0.5, 1.0, 0.0)


def test_selection_rules():
    matrix = [[1, 0.97, 0.1], [0.97, 1, 0.1], [0.1, 0.1, 1]]
    assert selection.drop_weaker(["a", "b", "c"], {"a": 0.2, "b": 0.5, "c": 0.1}, matrix) == ["b", "c"]
    names = ["team_win_rate_5g", "is_weekend", "x", "pts_hist_avg_5g", "home_advantage"]
    assert selection.win_priority(names) == ["team_win_rate_5g", "pts_hist_avg_5g", "is_weekend", "home_advantage"]
    assert selection.double_priority(["weighted_dd_rate_5g", "dd_rate_5g", "starter_boost", "z"]) == ["weighted_dd_rate_5g", "starter_boost", "dd_rate_5g"]
    assert selection.combined_scores([{"a": 4.0, "b": 2.0}, {"a": 0.5}]) == {"a": 0.75, "b": 0.5}


def test_f_scores_and_information(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    pdf = pd.DataFrame({"y": y, "good": y + rng.normal(0, 0.3, 500), "bad": rng.normal(0, 1, 500)})
    df = spark.createDataFrame(pdf)
    f = selection.f_scores(df, "y", ["good", "bad"])
    a, b = pdf.loc[y == 1, "good"], pdf.loc[y == 0, "good"]
    grand = pdf["good"].mean()
    between = len(a) * (a.mean() - grand) ** 2 + len(b) * (b.mean() - grand) ** 2
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert f["good"] == pytest.approx(between / (within / 498))
    mi = selection.binned_information(df, "y", ["good", "bad"])
    assert mi["good"] > 0.4 > 0.1 > mi["bad"]


def test_high_confidence_columns(spark):
    df = spark.range(30).select(col("id"), F.lit(0.85).alias("PTS_over_10_prob_5"), col("id").alias("PTS_over_10_line"), F.lit(0.1).alias("PTS_over_20_prob_5"))
    assert selection.high_confidence_columns(df, "PTS", ["id"]) == ["PTS_over_10_prob_5", "PTS_over_10_line"]
    assert selection.high_confidence_columns(df, "TRB", ["id"]) == []


def test_lines(spark):
    data = [(i, "p" if i % 2 else "q", float(i), f"2024-02-{1 + i // 2:02d}") for i in range(40)]
    df = spark.createDataFrame(data, "game_id int, Player string, PTS double, d string").withColumn("Date", F.to_date("d"))
    got = {r["line"]: r for r in lines.line_confidence(df, "PTS").collect()}
    assert got[10.0]["overs"] == 29 and got[10.0]["samples"] == 40
    flags = np.array([1.0] * 29 + [0.0] * 11)
    vol = flags.std(ddof=1)
    base = 0.725 * (1 - (vol - 0.3))
    steady = 1.0  # the 20 newest rows are all over 10
    assert got[10.0]["adjusted_confidence"] == pytest.approx(0.7 * base + 0.3 * steady)
    assert lines.line_confidence(df, "PTS", min_samples=41).count() == 0
    near = one(spark.createDataFrame([(12.5,)], "x double").select(*[c.alias(n) for n, c in lines.nearest_line(col("x"), [10, 15, 20]).items()]))
    assert near == {"closest_line": 10.0, "upper_line": 15.0, "lower_line": None}


def test_arbitrage_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    data = []
    for e in range(3):
        for s in ("over", "under"):
            for b in range(12):
                data.append((e, "PTS", 10.0, s, f"b{b:02d}", round(1.5 + rng.random() * 1.2, 1), "2024-01-01", f"q{b}"))
    df = spark.createDataFrame(data, "event_id int, target string, line double, side string, bookmaker string, price double, snapshot string, quote_id string")
    got = rows(markets.arbitrage_pairs(df.withColumn("snapshot", F.to_date("snapshot"))), "place")
    want = []
    for o in data:
        for u in data:
            if o[3] == "over" and u[3] == "under" and o[0] == u[0]:
                s = 1 / o[5] + 1 / u[5]
                if s < 1 and 1 / s - 1 >= 0.02:
                    want.append((-(1 / s - 1), o[0], o[4], u[4]))
    want = sorted(want)[:10]
    assert [(r["event_id"], r["over_bookmaker"], r["under_bookmaker"]) for r in got] == [w[1:] for w in want]
    assert all(math.isclose(r["over_weight"] + r["under_weight"], 1) for r in got)


def test_props(spark):
    doc = (
        '{"success": true, "last_update": "2024-01-01T06:00:00", "data": [{"commence_time": "2024-01-02T00:00:00Z", "home_team": "DEN", "away_team": "LAL",'
        '"bookmakers": [{"key": "BookA", "markets": [{"key": "player_points", "outcomes": [{"name": "N. Jok Over", "team": "DEN", "point": 25.5, "price": 1.9},'
        '{"name": "N. Jok Under", "team": "DEN", "point": 25.5, "price": 1.95}]}, {"key": "h2h", "outcomes": [{"name": "DEN", "price": 1.5}]}]}]}]}'
    )
    docs = odds_source.parse_snapshots(spark.createDataFrame([(doc,), ('{"success": false, "data": []}',), ("broken",)], "value string"))
    props = markets.explode_props(docs)
    got = rows(props, "outcome")
    assert [(r["player"], r["over_price"], r["under_price"], r["bookmaker"]) for r in got] == [("N. Jok", 1.9, None, "booka"), ("N. Jok", None, 1.95, "booka")]
    assert markets.explode_props(docs, player="jok", team="den", prop="points").count() == 2
    assert markets.explode_props(docs, prop="assists").count() == 0
    games = spark.createDataFrame([("N. Jok", 1), ("Other", 2)], "Player string, game int")
    joined = markets.props_to_games(games, markets.long_props(props).withColumnRenamed("player", "Player"))
    assert rows(joined, "game")[0]["odds"] == {"PTS_over_25.5_odds_booka": 1.9, "PTS_under_25.5_odds_booka": 1.95}
    assert rows(joined, "game")[1]["odds"] is None
    assert odds_source.fresh_snapshots(docs, "2024-01-01 17:00:00").count() == 1
    assert odds_source.fresh_snapshots(docs, "2024-01-01 18:00:00").count() == 0


def test_sides_and_targets_of_odd_names(spark):
    names = ["A  Over", "B UNDER", "over", "C over under", "Crossover", "Mr \t Under", "E\u00a0Over", "F over\n", "G Over \n", "Over H", "I over\r\n", "", None]
    markets_of = ["player_points_rebounds", "Player_3Pt", "player total assists", "player_blocks", "PLAYER PTS", None]
    outcomes = "array<struct<name: string, team: string, point: double, price: double>>"
    kind = f"data array<struct<commence_time: string, home_team: string, away_team: string, bookmakers: array<struct<key: string, markets: array<struct<key: string, outcomes: {outcomes}>>>>>>"
    made = [(m, [(n, "T", 1.0, 2.0) for n in names]) for m in markets_of]
    docs = spark.createDataFrame([([("2024-01-02", "H", "A", [("B", made)])],)], kind)
    props = markets.explode_props(docs)
    got = props.select("player", F.regexp_replace("outcome", r"(?i)\s*(over|under)$", "").alias("want")).collect()
    assert len(got) == len(names) * 5 and all(r["player"] == r["want"] for r in got)
    long = markets.long_props(props)
    found = {(r["prop_type"], t) for r in props.select("prop_type", markets.targets_of(col("prop_type")).alias("t")).collect() for t in r["t"]}
    assert found == {("player_points_rebounds", "PTS"), ("player_points_rebounds", "TRB"), ("Player_3Pt", "3P"), ("player total assists", "AST"), ("PLAYER PTS", "PTS")}
    priced = sum((n or "").lower().endswith(("over", "under")) for n in names)
    assert {r["target"]: r["count"] for r in long.groupBy("target").count().collect()} == {"PTS": 2 * priced, "TRB": priced, "3P": priced, "AST": priced}
    # the steps stay compiled: no lambda runs once per outcome
    assert "lambdafunction" not in long._jdf.queryExecution().optimizedPlan().toString()


def test_stakes_add_up(spark):
    data = [("PTS", float(i), "over", 0.97, 0.5, 0.47, 0.02, "value") for i in range(20)]
    df = spark.createDataFrame(data, "target string, line double, prediction string, adjusted_confidence double, market_probability double, edge double, kelly_fraction double, verdict string")
    got = one(markets.kelly_portfolio(markets.kelly_bets(df)))
    assert got["portfolio_size"] == 20 and got["total_risk"] == pytest.approx(0.25)
    empty = one(markets.kelly_portfolio(markets.kelly_bets(df.where("false"))))
    assert (empty["portfolio_size"], empty["total_risk"]) == (0, 0.0)


def test_staging_folder_comes_from_the_session():
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert staging_folder(session("hdfs://shared/ckpt/", "yarn")) == "hdfs://shared/ckpt"
    with pytest.raises(RuntimeError):
        staging_folder(session(None, "yarn"))
    with pytest.raises(RuntimeError):
        staging_folder(session(None, "local-cluster[3,2,3000]"))
    assert staging_folder(session(None, "local[8]")) == LOCAL_FOLDER


def test_split_counts_again_after_the_data_changed(spark, tmp_path):
    path = str(tmp_path / "rows")
    table = lambda a, b: spark.range(a, b).select(col("id").alias("game_id"))
    table(0, 100).write.parquet(path)
    first = splits.by_row_fraction(spark.read.parquet(path), ["game_id"])
    assert first.where("split = 'train'").count() == 80
    table(100, 1000).write.mode("append").parquet(path)
    again = splits.by_row_fraction(spark.read.parquet(path), ["game_id"])
    assert again.where("split = 'train'").count() == 800 and again.where("split <> 'train'").count() == 200


def test_props_without_a_bookmaker_line_or_side(spark):
    kind = "Player string, target string, line double, side string, bookmaker string, price double, game_time timestamp"
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    data = [("a", "PTS", 10.0, "over", None, 1.8, at), ("a", "PTS", None, "over", "x", 1.9, at), ("a", "PTS", 5.5, None, "x", 2.0, at), ("a", "PTS", 5.5, "under", "x", 2.1, at)]
    games = spark.createDataFrame([("a", "2024-01-02"), ("a", "2023-05-01"), ("b", "2024-01-02")], "Player string, Date string").withColumn("Date", col("Date").cast("date"))
    got = rows(markets.props_to_games(games, spark.createDataFrame(data, kind)), "Player", "Date")
    assert [r["odds"] for r in got] == [{"PTS_over_10_odds_unknown": 1.8, "PTS_under_5.5_odds_x": 2.1}] * 2 + [None]
    got = rows(markets.props_to_games(games, spark.createDataFrame(data, kind), as_of="2024-01-01"), "Player", "Date")
    assert [r["odds"] is not None for r in got] == [False, True, False]


RECORD = '{"event_id": 1, "target": "PTS", "line": 10.5, "side": "Over", "bookmaker": "x", "price": 1.9, "snapshot": "2024-01-02"}'
DOCUMENT = """{
  "success": true,
  "last_update": "2024-01-02T03:04:05",
  "data": [{"commence_time": "2024-01-03T00:00:00", "home_team": "H", "away_team": "A", "bookmakers": [
    {"key": "bm", "markets": [{"key": "player_points", "outcomes": [{"name": "P Over", "team": "H", "point": 10.5, "price": 1.9}]}]}]}]
}"""


def test_odds_json_in_every_form(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    forms = {"lines.json": f"{RECORD}\n{RECORD}\n", "array.json": f"[\n{RECORD},\n{RECORD}\n]", "pretty.json": RECORD.replace(", ", ",\n ").replace("{", "{\n")}
    for name, text in forms.items():
        got = odds_source.read_odds_file(spark, put(name, text)).collect()
        assert len(got) == (1 if name == "pretty.json" else 2) and all((r.event_id, r.line, r.side, r.price) == (1, 10.5, "over", 1.9) for r in got)
    nested = put("nested.json", DOCUMENT)
    with pytest.raises(ValueError, match="snapshot documents"):
        odds_source.read_odds_file(spark, nested)
    for path in (nested, put("one.json", DOCUMENT.replace("\n", " ") + "\n")):
        long = markets.long_props(markets.explode_props(odds_source.read_odds_document(spark, path))).collect()
        assert [(r.player, r.target, r.side, r.line, r.bookmaker) for r in long] == [("P", "PTS", "over", 10.5, "bm")]
    with pytest.raises(ValueError, match="no snapshot"):
        odds_source.read_odds_document(spark, put("flat.json", RECORD))
    with pytest.raises(Exception, match="(?i)malformed"):
        odds_source.read_odds_file(spark, put("broken.json", RECORD + "\n{broken\n")).collect()


def test_modes_in_one_pass(spark):
    df = spark.createDataFrame([("x", "b", None), ("x", "a", None), ("y", "b", None), (None, "a", None)], "p string, q string, r string")
    assert cleaning.modes(df, ["p", "q", "r"]) == {"p": "x", "q": "a", "r": "0"} and cleaning.modes(df, []) == {}


def test_many_correlations_are_those_of_one_aggregate(spark, monkeypatch):
    from courtspark.operators import profiles

    x = [F.when(F.rand(i) < 0.9, F.rand(10 + i)).alias(f"x{i}") for i in range(5)]
    df = spark.range(300).select(*x, F.lit(1.0).alias("flat"), F.lit(None).cast("double").alias("none"))
    pairs = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :]]
    asked = lambda d: {(r["a"], r["b"]): r["r"] for r in profiles.correlations(d, pairs).collect()}
    long, empty = asked(df), asked(df.limit(0))
    plan = profiles.correlations(df, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan
    monkeypatch.setattr(profiles, "WIDE_PAIRS", 60)
    wide = asked(df)
    assert len(pairs) > 8 and set(long) == set(wide) == set(empty) and set(empty.values()) == {None}
    assert all((long[k] is None) == (wide[k] is None) and (wide[k] is None or abs(long[k] - wide[k]) < 1e-9 or long[k] != long[k] and wide[k] != wide[k]) for k in wide)
