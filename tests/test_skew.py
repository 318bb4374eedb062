"""A model with most of the rows, through the ways of large data, gives the results of the plain ways."""

import pytest
from conftest import rows_of
from fixtures import features
from pyspark.sql import functions as F

from buildscope.operators import anomaly, checks, forest, geometry, metrics, portfolio, preprocess
from buildscope.plans import quantiles
from buildscope.schemas import MESHES


@pytest.fixture(scope="module")
def skewed(spark):
    rows = []
    for i in range(900):
        model = "hot" if i % 3 else f"m{i % 11}"
        values = [((i * (k + 7) * 7919) % 1009) / 10.0 + (5e5 if i % 97 == 0 else 0.0) for k in range(9)]
        values[8] = None if i % 5 == 0 else values[8]
        name = None if i % 13 == 0 else "copy"
        rows.append((model, "same" if i % 2 else f"g{i}", "IfcWall", name, "t", i % 17 != 0, *values))
    return features(spark, rows).withColumn("element_key", F.monotonically_increasing_id()).cache()


@pytest.fixture
def large_ways(monkeypatch, forced_shuffle):
    monkeypatch.setattr(quantiles, "MAP_ROWS", 20)
    monkeypatch.setattr(quantiles, "SORT_ROWS", 40)


def work(df):
    issues = checks.run_all_checks(df)
    prepared, _ = preprocess.preprocess_features(df, identity=("global_id", "ifc_type", "element_key"))
    score = prepared.withColumn("anomaly_score", -F.abs("dim_x") - F.abs("aspect_ratio_xz"))
    flagged = anomaly.flag_anomalies(score.select("model_id", "global_id", "ifc_type", "element_key", "anomaly_score"))
    return {
        "issues": rows_of(issues),
        "summary": rows_of(metrics.model_summary(df, issues)),
        "results": rows_of(portfolio.model_results(df, flagged).drop("processed_at")),
        "prepared": rows_of(prepared),
        "flagged": rows_of(flagged),
    }


@pytest.fixture(scope="module")
def plain(skewed):
    return work(skewed)


def test_same_results(skewed, plain, large_ways):
    found = work(skewed)
    for name, expected in plain.items():
        assert found[name] == expected, name


def test_hot_id_finds_its_mesh(spark, skewed, large_ways):
    ids = skewed.select("model_id", "global_id")
    meshes = ids.distinct().select(
        "model_id", "global_id", F.lit(1).cast("long").alias("entity_id"), F.array(*[F.lit(float(v)) for v in range(6)]).alias("verts")
    )
    assert meshes.schema.names == MESHES.names
    found = geometry.compute_geometry_features(ids, meshes)
    assert found.count() == 900 and found.filter("dim_x = 3.0").count() == 900


def test_forest_of_a_hot_model(skewed, large_ways):
    options = {"contamination": 0.05, "n_estimators": 5, "max_samples": 32}
    first = forest.AnomalyDetector(**options, rows_per_task=50).fit_predict(skewed)
    second = forest.AnomalyDetector(**options).fit_predict(skewed)
    columns = ("model_id", "element_key", "anomaly_score", "is_anomaly")
    assert first.count() == skewed.filter("has_geometry").count()
    assert rows_of(first, *columns) == rows_of(second, *columns)


def test_a_written_table_holds_all_rows_of_a_hot_model(spark, skewed, tmp_path):
    from buildscope.sources.tables import save_by_model

    save_by_model(skewed.select("model_id", "global_id"), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert rows_of(back.groupBy("model_id").count()) == rows_of(skewed.groupBy("model_id").count())
