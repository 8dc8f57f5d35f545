"""Seconds per headline query, as one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query writes its
whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from courtspark.registry.all import REGISTRY
from courtspark.session import local_session

HEADLINES = (
    "team_form", "parse_result_player", "join_biometrics", "hist_roll", "roll_then_shift", "win_rates",
    "weighted_rate", "dd_streak", "opponent_form", "opponent_strength", "pair_history", "features_win",
    "team_projection", "total_projection", "features_double_double", "longest_streak", "player_vs_lines",
    "line_confidence", "bookmaker_stats", "market_edges", "arbitrage_pairs", "line_movement", "odds_wide",
    "explode_props", "props_to_games", "winsorize_quantile", "transform_set", "impute_median_chain",
    "split_by_row_fraction", "regression_metrics", "classification_metrics", "roc_curve",
    "optimize_threshold_dd", "evaluate_thresholds", "weighted_ensemble", "rule_predictor", "train_forest",
    "train_linear", "train_gbt", "train_total_bundle", "score_games", "cv_fit_time_series",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or [n for n in HEADLINES if n in REGISTRY]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    REGISTRY["team_form"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
