import json

import pytest
from conftest import rows_of
from fixtures import GEOMETRY, features
from pyspark.sql import functions as F

from buildscope.operators import checks, portfolio, views
from buildscope.plans import pipeline
from buildscope.schemas import MODEL_RESULTS
from buildscope.sources import tables


def results(spark, *rows):
    """Rows of (name, status, score, total issues, critical issues, rate, anomaly count, anomaly rate)."""
    full = [
        (n, f"{n}.ifc", s, 100, t, c, 0, t - c, float(q), float(r), 50.0, a, ar, 1.0, "now", None if s == "success" else "E: bad")
        for n, s, q, t, c, r, a, ar in rows
    ]
    return spark.createDataFrame(full, MODEL_RESULTS)


def five(spark):
    return results(
        spark,
        ("a", "success", 94.5, 5, 0, 10, 5, 0.05),
        ("b", "success", 70, 30, 2, 300, 0, 0.0),
        ("c", "success", 0, 90, 9, 900, None, None),
        ("d", "success", 80, 30, 2, 200, 3, 0.03),
        ("e", "success", 94.5, 1, 0, 10, 3, 0.03),
        ("x", "failure", 0, 0, 0, 0, None, None),
    )


def test_kpis(spark):
    row = portfolio.portfolio_kpis(five(spark)).first()
    assert (row["total_models"], row["success_models"], row["failed_models"]) == (6, 5, 1)
    assert row["success_rate"] == 5 / 6
    assert row["avg_quality_score"] == pytest.approx(67.8)
    assert row["median_quality_score"] == 80.0
    assert row["p95_issue_rate_per_1k"] == pytest.approx(780.0)
    assert row["total_issues"] == 156 and row["total_elements"] == 500


def test_one_model_has_no_deviation(spark):
    row = portfolio.portfolio_kpis(results(spark, ("a", "success", 50, 1, 0, 1, None, None))).first()
    assert row["std_quality_score"] is None and row["avg_quality_score"] == 50.0


def test_no_success(spark):
    row = portfolio.portfolio_kpis(results(spark, ("x", "failure", 0, 0, 0, 0, None, None))).first()
    assert (row["total_models"], row["success_models"], row["failed_models"]) == (1, 0, 1)
    assert row["success_rate"] is None and row["avg_quality_score"] is None and row["total_issues"] is None


def test_empty_portfolio(spark):
    assert portfolio.portfolio_kpis(results(spark)).count() == 0


def test_best_and_worst_break_ties_by_name(spark):
    assert tuple(portfolio.best_worst_model(five(spark)).first()) == ("a", "c")


def test_anomaly_kpis(spark):
    row = portfolio.portfolio_anomaly_kpis(five(spark)).first()
    assert (row["models_with_ml"], row["total_anomalies"], row["max_anomaly_rate"]) == (4, 11, 0.05)
    assert row["median_anomaly_rate"] == pytest.approx(0.03)
    assert portfolio.portfolio_anomaly_kpis(results(spark, ("a", "success", 1, 1, 1, 1, None, None))).count() == 0


def test_top_models_need_five_successes(spark):
    assert rows_of(portfolio.top_models(five(spark), "critical_issues"))[:2] == [("a", 0), ("b", 2)]
    assert portfolio.top_models(five(spark).filter("model_name <> 'a'"), "critical_issues").count() == 0


def test_threshold_is_strict(spark):
    row = portfolio.below_threshold(five(spark)).first()
    assert (row["models_below_threshold"], row["pct_below_threshold"]) == (2, 40.0)


def test_document(spark):
    row = portfolio.portfolio_metrics(five(spark)).first().asDict(recursive=True)
    assert row["best_model"] == "a" and row["total_anomalies"] == 11
    assert [m["model_name"] for m in row["top_models_by_issues"]] == ["c", "b", "d", "a", "e"]


def test_document_without_success(spark):
    row = portfolio.portfolio_metrics(results(spark, ("x", "failure", 0, 0, 0, 0, None, None))).first()
    assert (row["failed_models"], row["best_model"], row["total_anomalies"]) == (1, None, None)


def test_critical_top_falls_back_to_total(spark):
    found = views.critical_or_total_top(five(spark), 2)
    assert rows_of(found) == [("b", 2, "critical_issues"), ("c", 9, "critical_issues")]
    calm = five(spark).withColumn("critical_issues", F.lit(0).cast("long"))
    assert rows_of(views.critical_or_total_top(calm, 2)) == [("b", 30, "total_issues"), ("c", 90, "total_issues")]


def test_histogram_keeps_empty_bins(spark):
    found = rows_of(views.issue_rate_histogram(five(spark)), "bin", "model_count")
    assert len(found) == 20 and sum(n for _, n in found) == 5
    assert dict(found)[0] == 2 and dict(found)[19] == 1
    same = results(spark, ("a", "success", 1, 1, 1, 7, None, None))
    assert dict(rows_of(views.issue_rate_histogram(same), "bin", "model_count"))[0] == 1


def test_other_views(spark):
    assert rows_of(views.failed_models(five(spark))) == [("x", "E: bad")]
    assert [r["model_name"] for r in views.quality_ranking(five(spark)).collect()] == ["c", "b", "d", "a", "e"]
    assert [r["model_name"] for r in views.anomaly_rate_top(five(spark)).collect()] == ["a", "d", "e"]
    gates = dict(rows_of(views.quality_gate(five(spark)), "model_name", "gate"))
    assert gates["d"] == "PASS" and gates["b"] == "FAIL"


def test_top_issues_by_severity(spark):
    rows = [("m", f"g{i:02d}", "t", "x", s, "msg", None) for i, s in enumerate(["minor", "major", "critical", "odd"] * 10)]
    from buildscope.schemas import ISSUES

    found = views.top_issues(spark.createDataFrame(rows, ISSUES)).orderBy("rank").collect()
    assert [r["severity"] for r in found] == ["critical"] * 10 + ["major"] * 10


def portfolio_features(spark):
    rows = [(f"m{m}", f"id{m}-{i}", *r[2:]) for m in range(3) for i in range(8) for r in GEOMETRY[:2]]
    return features(spark, rows).withColumns(
        {"description": F.lit(None).cast("string"), "predefined_type": F.lit(None).cast("string"), "bbox_volume": F.lit(1.0)}
    )


def test_results_agree_with_issues(spark):
    df = portfolio_features(spark)
    found = {r["model_name"]: r for r in portfolio.model_results(df).collect()}
    issues = {r["model_id"]: r["count"] for r in checks.run_all_checks(df).groupBy("model_id").count().collect()}
    assert {k: r["total_issues"] for k, r in found.items()} == issues
    assert found["m0"]["element_count"] == 16 and found["m0"]["anomaly_count"] is None


def test_whole_analysis(spark, tmp_path):
    failures = spark.createDataFrame([("bad", "bad.ifc", "E: unreadable")], "model_name string, model_path string, error_message string")
    out = str(tmp_path / "out")
    document = pipeline.run_portfolio_analysis(
        portfolio_features(spark), out, failures=failures, enable_ml=True, n_estimators=5, quality_threshold=80.0
    ).first()
    assert (document["total_models"], document["failed_models"]) == (4, 1)
    assert document["total_anomalies"] is not None
    summary, metrics = tables.load_portfolio_data(spark, out)
    assert summary.count() == 4 and metrics.first()["total_models"] == 4
    rows, issues, model_metrics = tables.load_model_data(spark, out, "m1")
    assert rows.count() == 16 and model_metrics.count() == 1
    assert {r["model_id"] for r in issues.collect()} == {"m1"}
    assert tables.load_anomalies(spark, f"{out}/anomalies").count() == 48
    text = spark.read.text(f"{out}/portfolio_metrics.json").first()[0]
    assert json.loads(text)["quality_threshold"] == 80.0


def test_the_filter_on_one_model_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "features")
    tables.save_features(portfolio_features(spark), path)
    plan = tables.load_features(spark, path).filter("model_id = 'm1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(model_id,m1)" in plan


def test_missing_inputs(spark, tmp_path):
    from pyspark.errors import AnalysisException

    none = str(tmp_path / "none")
    with pytest.raises(AnalysisException):
        tables.load_features(spark, none).count()
    with pytest.raises(AnalysisException):
        tables.load_portfolio_data(spark, none)[0].count()
    assert tables.load_issues(spark, none).count() == 0
    tables.save_features(portfolio_features(spark), f"{none}/features")
    _, issues, metrics = tables.load_model_data(spark, none, "m0")
    assert issues.count() == 0 and metrics.count() == 0


def test_unreadable_issue_files_are_skipped(spark, tmp_path):
    df = portfolio_features(spark).withColumn("name", F.lit(""))
    path = str(tmp_path / "issues")
    tables.save_issues(checks.run_all_checks(df), path)
    before = tables.scan_issues(spark, path).count()
    (tmp_path / "issues" / "part-x.parquet").write_text("broken")
    assert tables.scan_issues(spark, path).count() == before > 0


def test_directory_analysis(spark, tmp_path):
    from buildscope.schemas import MESHES

    source = tmp_path / "models"
    source.mkdir()
    head = "ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n"
    walls = "".join(f"#{i}=IFCWALL('w{i}',#1,'n',$,$,#5,#6,$,$);\n" for i in range(1, 21))
    (source / "good.ifc").write_text(head + walls + "ENDSEC;\n")
    (source / "bad.ifc").write_text("nonsense")
    meshes = spark.createDataFrame([("good", f"w{i}", i, [0.0] * 3 + [1.0, 2.0, float(i)]) for i in range(1, 11)], MESHES)
    found = pipeline.analyse_directory(spark, str(source), str(tmp_path / "out"), meshes, enable_ml=True, n_estimators=3).first()
    assert (found["total_models"], found["success_models"], found["failed_models"]) == (2, 1, 1)
    assert found["total_elements"] == 20 and found["total_minor_issues"] == 20
    summary, _ = tables.load_portfolio_data(spark, str(tmp_path / "out"))
    failed = summary.filter("status = 'failure'").first()
    assert failed["model_name"] == "bad" and failed["error_message"].startswith("IFCLoadError: Failed to parse")
    rows, _, _ = tables.load_model_data(spark, str(tmp_path / "out"), "good")
    assert rows.filter("has_geometry").count() == 10
    bare = pipeline.analyse_directory(spark, str(source), str(tmp_path / "bare")).first()
    assert bare["total_elements"] == 20 and bare["total_anomalies"] is None
