from conftest import rows_of
from fixtures import GEOMETRY, elements, features
from pyspark.sql import functions as F

from buildscope.functions.columns import missing_to_null
from buildscope.operators import checks
from buildscope.schemas import ISSUES


def found(df):
    return rows_of(df, "global_id", "issue_type", "severity")


def test_missing_name(spark):
    issues = checks.check_missing_name(elements(spark))
    assert found(issues) == [("id2", "missing_name", "major"), ("id3", "missing_name", "major")]
    assert {r["element_name"] for r in issues.collect()} == {None}


def test_missing_object_type(spark):
    assert found(checks.check_missing_object_type(elements(spark))) == [
        ("id3", "missing_object_type", "minor"),
        ("id4", "missing_object_type", "minor"),
    ]


def test_white_space_is_a_name(spark):
    df = elements(spark, [("m", "a", "IfcWall", " ", " ")])
    assert checks.run_all_checks(df).count() == 0


def _duplicates(spark):
    ids = ["id1", "id2", "id2", "id3", "id3", "id3", None, None]
    return elements(spark, [("m", i, "IfcWall", f"n{k}", "t") for k, i in enumerate(ids)])


def test_duplicates(spark):
    issues = checks.check_duplicate_global_ids(_duplicates(spark)).collect()
    assert len(issues) == 5
    assert sorted(i["message"] for i in issues) == ["GlobalId appears 2 times (must be unique)"] * 2 + [
        "GlobalId appears 3 times (must be unique)"
    ] * 3
    assert {i["severity"] for i in issues} == {"critical"}


def test_duplicates_stay_within_a_model(spark):
    df = elements(spark, [("a", "x", "IfcWall", "n", "t"), ("b", "x", "IfcWall", "n", "t")])
    assert checks.check_duplicate_global_ids(df).count() == 0


def test_duplicates_with_a_hot_id(spark, forced_shuffle):
    rows = [("m", "hot", "IfcWall", "same", "t")] * 40
    rows += [("m", f"id{i // 2}", "IfcDoor", f"n{i}", "t") for i in range(20)]
    rows += [("m", f"one{i}", "IfcDoor", "n", "t") for i in range(20)]
    issues = checks.check_duplicate_global_ids(elements(spark, rows))
    assert issues.filter("global_id = 'hot'").count() == 40
    assert issues.count() == 60
    assert {r[0] for r in issues.select("message").distinct().collect()} == {
        "GlobalId appears 40 times (must be unique)",
        "GlobalId appears 2 times (must be unique)",
    }


def test_degenerate(spark):
    df = features(spark)
    assert found(checks.check_degenerate_geometry(df)) == [("id3", "degenerate_geometry", "major")]
    assert checks.check_degenerate_geometry(df, 0.5).count() == 3
    message = checks.check_degenerate_geometry(df).first()["message"]
    assert message == "Dimension dim_x = 0.000500 (< 0.001m)"


def test_extreme(spark):
    df = features(spark)
    issue = checks.check_extreme_dimensions(df).collect()
    assert [(i["global_id"], i["severity"]) for i in issue] == [("id4", "critical")]
    assert issue[0]["message"] == "Dimension dim_x = 15000.00m (> 10000.0m, possible scale issue)"
    assert checks.check_extreme_dimensions(df, 5.0).count() > 1


def test_coordinates(spark):
    issue = checks.check_coordinate_anomalies(features(spark)).collect()
    assert [i["global_id"] for i in issue] == ["id4"]
    assert issue[0]["message"] == "Element 120000.00m from origin (> 100000.0m)"


def test_coordinates_need_all_axes(spark):
    assert checks.check_coordinate_anomalies(features(spark).drop("centroid_z")).count() == 0
    gap = features(spark).withColumn("centroid_y", F.lit(None).cast("double"))
    assert checks.check_coordinate_anomalies(gap).count() == 0


def test_ratios(spark):
    issues = checks.check_extreme_aspect_ratios(features(spark))
    assert rows_of(issues, "global_id") == [("id3",), ("id3",), ("id4",), ("id4",)]
    assert {r["severity"] for r in issues.collect()} == {"minor"}


def test_only_elements_with_geometry(spark):
    df = features(spark).withColumn("has_geometry", F.lit(None).cast("boolean"))
    assert checks.run_all_checks(df).count() == 0


def test_all_checks(spark):
    assert checks.run_all_checks(features(spark)).count() == 7


def test_all_checks_without_geometry_columns(spark):
    issues = checks.run_all_checks(elements(spark))
    assert {r["issue_type"] for r in issues.collect()} == {"missing_name", "missing_object_type"}


def test_clean_rows_have_no_issue(spark):
    assert checks.run_all_checks(features(spark, [GEOMETRY[0], GEOMETRY[1]])).count() == 0


def test_empty_input(spark):
    issues = checks.run_all_checks(features(spark, []))
    assert issues.count() == 0
    assert issues.columns == ISSUES.fieldNames()
    assert checks.empty_issues(elements(spark)).schema == ISSUES


def test_nan_is_missing(spark):
    df = missing_to_null(features(spark, [GEOMETRY[0][:6] + (float("nan"),) * 9]))
    assert checks.run_all_checks(df).count() == 0
    assert df.first()["dim_x"] is None


def test_summary(spark):
    rows = [("m", "a", "t", i, s, "x", None) for i, s in (
        ("missing_name", "major"), ("missing_name", "major"), ("missing_object_type", "minor"), ("duplicate_global_id", "critical"))]
    row = checks.issues_summary(spark.createDataFrame(rows, ISSUES)).first()
    assert (row["total_issues"], row["critical_count"], row["major_count"], row["minor_count"]) == (4, 1, 2, 1)
    assert row["by_severity"] == {"critical": 1, "major": 2, "minor": 1}
    assert row["by_type"] == {"missing_name": 2, "missing_object_type": 1, "duplicate_global_id": 1}


def test_summary_of_a_clean_model(spark):
    empty = checks.empty_issues(elements(spark))
    row = checks.with_clean_models(checks.issues_summary(empty), elements(spark)).first()
    assert (row["total_issues"], row["by_severity"], row["by_type"]) == (0, {}, {})


def test_counts_agree_with_issues(spark):
    df = features(spark).unionByName(features(spark))
    counted = checks.count_issues_by_model(df).first().asDict()
    made = {r["issue_type"]: r["count"] for r in checks.run_all_checks(df).groupBy("issue_type").count().collect()}
    assert {k: v for k, v in counted.items() if k in checks.SEVERITY_OF and v} == made


def test_health_counts_rows_less_ids(spark):
    df = elements(spark, [("m", "a", "W", None, "t"), ("m", "a", "W", None, "t"), ("m", "b", "W", "n", "t")])
    row = checks.model_health(df, checks.run_all_checks(df)).first()
    assert (row["total_elements"], row["elements_with_issues"], row["clean_elements"]) == (3, 1, 2)


def test_score_tiers(spark):
    scores = spark.createDataFrame([(s,) for s in (100.0, 90.0, 89.9, 70.0, 50.0, 49.9)], "s double")
    tiers = [r[0] for r in scores.select(checks.score_tier(F.col("s"))).collect()]
    assert tiers == ["excellent", "excellent", "good", "good", "moderate", "poor"]


def test_samples_per_severity(spark):
    rows = [("m", f"id{i:02d}", "t", "missing_name", "major", "x", None) for i in range(9)]
    sample = checks.severity_samples(spark.createDataFrame(rows, ISSUES))
    assert [r["global_id"] for r in sample.orderBy("sample_rank").collect()] == [f"id{i:02d}" for i in range(5)]


def test_local_rules_do_not_shuffle(spark):
    df = spark.createDataFrame(GEOMETRY, features(spark).schema)
    plan = checks.local_issues(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
