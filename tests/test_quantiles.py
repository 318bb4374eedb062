"""Exact quantiles against numpy, on each of the three ways."""

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from buildscope.plans.quantiles import exact_quantiles, quantile_name

PROBS = [0.02, 0.25, 0.5, 0.75, 0.95]


def _groups():
    rng = np.random.default_rng(7)
    return {
        "uniform": rng.random(3000) * 100,
        "outliers": np.concatenate([rng.normal(1, 1e-6, 2500), [1e12, -1e12, 5e9]]),
        "copies": np.concatenate([np.full(2000, 4.25), rng.random(900)]),
        "negative": -np.exp(rng.normal(0, 9, 2200)),
        "small": rng.random(7),
        "pair": np.array([1.0, 2.0]),
        "one": np.array([3.5]),
    }


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, float(v), None if i % 3 == 0 else float(v) * 2) for k, vs in _groups().items() for i, v in enumerate(vs)]
    rows += [("void", None, None)] * 5
    return spark.createDataFrame(rows, "model_id string, a double, b double").repartition(5).cache()


WAYS = {
    "map": {},
    "sort": {"map_rows": 1},
    "bracket": {"map_rows": 1, "sort_rows": 5, "accuracy": 100},
    "mixed": {"map_rows": 5, "sort_rows": 2100, "accuracy": 50},
}


@pytest.mark.parametrize("way", WAYS)
def test_quantiles(spark, values, way):
    found = {r["model_id"]: r for r in exact_quantiles(values, ["a", "b"], PROBS, **WAYS[way]).collect()}
    assert set(found) == {*_groups(), "void"}
    for key, group in _groups().items():
        present = {"a": group, "b": np.array([v * 2 for i, v in enumerate(group) if i % 3])}
        for column, expected in present.items():
            for p in PROBS:
                got = found[key][quantile_name(column, p)]
                if len(expected) == 0:
                    assert got is None
                else:
                    assert got == pytest.approx(np.quantile(expected, p), rel=1e-12, abs=1e-300), (key, column, p)
    assert found["void"][quantile_name("a", 0.5)] is None


def test_a_missed_bracket_is_sorted_whole(spark, values, monkeypatch):
    """Without a margin the sketch's brackets miss ranks; the result must not change."""
    from buildscope.plans import quantiles

    expected = {r["model_id"]: r for r in exact_quantiles(values, ["a", "b"], PROBS).collect()}
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    found = {r["model_id"]: r for r in exact_quantiles(values, ["a", "b"], PROBS, map_rows=1, sort_rows=5, accuracy=20).collect()}
    assert found == expected


def test_small_groups_have_the_bits_of_percentile(spark, values):
    """Many groups in a task, one with a null key, one whose values are partly missing, whole numbers."""
    wide = values.selectExpr("CASE WHEN model_id <> 'pair' THEN model_id END AS model_id", "a", "b", "TRY_CAST(a AS INT) AS c")
    wide = wide.unionByName(spark.range(30_000).selectExpr("'k' || (id % 900) AS model_id", "rand(1) AS a", "CASE WHEN id % 7 > 0 THEN id / 3 END AS b", "CAST(id AS INT) AS c"))
    found = exact_quantiles(wide, ["a", "b", "c"], PROBS)
    assert "percentile" not in found._jdf.queryExecution().toString()
    lists = wide.groupBy("model_id").agg(*[F.percentile(x, PROBS).alias(x) for x in "abc"])
    expected = lists.select("model_id", *[F.col(x)[j].alias(quantile_name(x, p)) for x in "abc" for j, p in enumerate(PROBS)])
    assert rows_of(found) == rows_of(expected) and found.count() == 908
