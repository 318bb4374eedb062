import json

import pytest
from conftest import rows_of
from fixtures import elements
from pyspark.sql import functions as F

from buildscope.operators import checks, metrics
from buildscope.schemas import ISSUES
from buildscope.sources import tables

ISSUE_ROWS = [
    ("m", "id2", "IfcDoor", "missing_name", "major", "x", None),
    ("m", "id3", "IfcWindow", "missing_name", "major", "x", None),
    ("m", "id3", "IfcWindow", "missing_object_type", "minor", "x", None),
]


@pytest.fixture
def issues(spark):
    return spark.createDataFrame(ISSUE_ROWS, ISSUES)


@pytest.fixture
def rows(spark):
    return elements(spark).withColumn("has_geometry", F.col("global_id") != "id2")


def test_summary(rows, issues):
    row = metrics.model_summary(rows, issues).first()
    assert (row["total_elements"], row["total_issues"], row["critical"], row["major"], row["minor"]) == (4, 3, 0, 2, 1)
    assert row["issue_rate_per_1000"] == 750.0
    assert (row["name_pct"], row["object_type_pct"], row["geometry_pct"]) == (50.0, 50.0, 75.0)
    assert row["quality_score"] == 0.0


def test_published_score(spark):
    # 973 elements, 1 major and 89 minor issues.
    rows = elements(spark, [("m", str(i), "t", "n", "o") for i in range(973)])
    found = [("m", str(i), "t", "missing_object_type", "minor", "x", None) for i in range(89)]
    found.append(("m", "0", "t", "missing_name", "major", "x", None))
    row = metrics.model_summary(rows, spark.createDataFrame(found, ISSUES)).first()
    assert row["quality_score"] == pytest.approx(90.6, abs=0.06)
    assert row["issue_rate_per_1000"] == pytest.approx(92.5, abs=0.01)


def test_no_issues_is_a_full_score(rows, spark):
    row = metrics.model_summary(rows, spark.createDataFrame([], ISSUES)).first()
    assert (row["quality_score"], row["total_issues"], row["critical"]) == (100.0, 0, 0)


def test_severity_weights(spark):
    rows = elements(spark, [("m", str(i), "t", "n", "o") for i in range(100)])
    found = [("m", "0", "t", "x", s, "x", None) for s in ("CRITICAL", "odd", None)]
    issues = spark.createDataFrame(found, ISSUES)
    # Weights match in lower case, others weigh one; counts match exactly.
    row = metrics.model_summary(rows, issues).first()
    assert row["quality_score"] == 95.0
    assert row["critical"] == 0
    assert metrics.quality_scores(rows, issues, {"critical": 10.0}).first()["quality_score"] == 88.0
    assert metrics.quality_scores(rows, issues, {}).first()["quality_score"] == 95.0
    assert metrics.quality_scores(rows, issues.drop("severity")).first()["quality_score"] == 97.0


def test_missing_columns_count_as_zero(spark, issues):
    row = metrics.metadata_completeness(elements(spark).select("model_id", "name")).first()
    assert (row["name_pct"], row["object_type_pct"], row["geometry_pct"]) == (50.0, 0.0, 0.0)


def test_pareto(issues):
    table = rows_of(metrics.pareto_issue_types(issues), "rank", "issue_type", "count", "cum_pct")
    assert table == [(1, "missing_name", 2, 2 / 3), (2, "missing_object_type", 1, 1.0)]
    assert metrics.pareto_issue_types(issues, 1).count() == 1


def test_pareto_shares(spark):
    counts = spark.createDataFrame([("m", "a", 20), ("m", "b", 15), ("m", "c", 10)], "model_id string, issue_type string, count long")
    assert rows_of(metrics.pareto(counts), "issue_type", "pct", "cum_pct") == [
        ("a", 20 / 45, 20 / 45), ("b", 15 / 45, 35 / 45), ("c", 10 / 45, 1.0)]


def test_top_offenders_break_ties_by_key(spark):
    rows = [("m", "x", t, "i", "minor", "x", None) for t in ("b", "a", "c", "c")] + [("m", "x", None, "i", "minor", "x", None)]
    top = metrics.top_offenders(spark.createDataFrame(rows, ISSUES), "ifc_type", 2)
    assert rows_of(top, "rank", "ifc_type", "count") == [(1, "c", 2), (2, "a", 1)]


def test_long_frames(rows, issues):
    summary = metrics.model_summary(rows, issues)
    kpis = {r["metric"]: r["value"] for r in metrics.kpi_long(summary).collect()}
    assert len(kpis) == 10 and kpis["total_issues"] == 3.0
    assert rows_of(metrics.severity_frame(summary), "severity", "count") == [("critical", 0), ("major", 2), ("minor", 1)]


def test_document_round_trip(spark, rows, issues, tmp_path):
    document, frames = metrics.build_metrics(rows, issues)
    assert set(frames) == {"kpi", "severity", "issues_by_ifc_type", "issues_by_type", "pareto_issue_types"}
    row = document.first().asDict(recursive=True)
    assert row["top_offenders"]["ifc_type"] == {"IfcWindow": 2, "IfcDoor": 1}
    assert [p["issue_type"] for p in row["pareto_issue_types"]] == ["missing_name", "missing_object_type"]
    tables.save_metrics(document, str(tmp_path / "metrics"))
    saved = json.loads(spark.read.text(str(tmp_path / "metrics")).first()[0])
    assert saved["severity_breakdown"] == {"critical": 0, "major": 2, "minor": 1}


def test_document_of_a_clean_model(rows, spark):
    row = metrics.build_metrics(rows, checks.empty_issues(rows))[0].first()
    assert row["top_offenders"]["issue_type"] == {} and row["pareto_issue_types"] == []
