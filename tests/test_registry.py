"""Some registered queries without an SQL twin answer on the smallest tables; models are cut down to a few trees."""

import pytest

from courtspark.operators import models
from courtspark.registry.all import REGISTRY

SF = "/root/testdata/sf0.001"
#: The other queries without a twin fit the same models; those are tested on a small table in test_models.py.
NAMES = ("train_targets", "evaluate_model", "train_forest_sweep", "feature_columns")


@pytest.fixture
def few_trees(monkeypatch):
    small = {k: v | {"forest_trees": 3, "boost_trees": 3, "forest_depth": min(v["forest_depth"], 4)} for k, v in models.LEVELS.items()}
    monkeypatch.setattr(models, "LEVELS", small)
    monkeypatch.setattr(models.forest_sweep, "__defaults__", ((2, 3), "win"))


@pytest.mark.parametrize("name", NAMES)
def test_answers(spark, few_trees, name):
    rows = REGISTRY[name].run(spark, SF).collect()
    assert rows
    if name == "train_targets":
        assert {r["target"] for r in rows} == {"win", "points", "total", "double"} and all(r["inputs"] > 0 for r in rows)
