"""Registered queries against their SQL in DuckDB.

Every query by default; FEW_QUERIES=1 compares a cross-section.
"""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as contract
from buildscope.workload import catalog, oracles
from tools.compare import SAME_TYPE, TABLES, canonical

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SECTION = [
    "step_elements", "model_metadata", "validate_models", "features_roundtrip", "geometry_summary", "geometry_features",
    "element_summary_top3", "feature_stats", "volume_extremes", "run_all_checks", "severity_samples", "quality_score",
    "metrics_document", "model_results_with_failures", "portfolio_kpis", "critical_or_total_top", "issue_rate_histogram",
    "issues_sink_pareto", "top_issues", "preprocess_features", "anomaly_flag",
]
TOP_LISTS = {
    "step_elements_first_100", "geometry_features", "element_summary_top10", "element_summary_top3", "geometry_sample",
    "severity_samples", "top_offenders_ifc_type", "top_offenders_issue_type", "pareto_top_n", "metrics_document",
    "top_issues", "top_anomalies", "anomaly_top10", "anomaly_by_type",
}
QUERIES, SQL = catalog.QUERIES, oracles.all_sql()
CHOSEN = SECTION if os.environ.get("FEW_QUERIES") else sorted(SQL)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip(f"no test data in {SF}")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A top list per model is cut before the shuffle.
    assert ("WindowGroupLimit" in plan) == (name in TOP_LISTS)
    columns = sorted(found.columns)
    expected = db.sql(SQL[name])
    assert sorted(expected.columns) == columns
    types = {c: str(t) for c, t in zip(expected.columns, expected.types)}
    assert {c: SAME_TYPE[t] for c, t in found.dtypes} == types
    order = [expected.columns.index(c) for c in columns]
    left = Counter(tuple(canonical(r[c]) for c in columns) for r in found.collect())
    right = Counter(tuple(canonical(r[i]) for i in order) for r in expected.fetchall())
    assert left == right


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert contract.entry(spark).count() > 0


def test_a_drill_down_writes_rows_of_its_model_only(spark, monkeypatch):
    from buildscope.operators import anomaly, checks, preprocess

    written = []

    def recording(materialize):
        def wrapped(df, label="table"):
            out = materialize(df, label)
            if "model_id" in out.columns:
                written.append({r[0] for r in out.select("model_id").distinct().collect()})
            return out

        return wrapped

    for module in (anomaly, checks, preprocess, catalog):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", recording(module.materialize))
    assert catalog.model_drilldown(spark, SF).count() == 1
    assert written and set.union(*written) == {catalog.DRILLDOWN_MODEL}


def test_the_core_does_not_need_the_libraries_of_the_optional_part():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'quality_score' in e.queries() and 'pipeline' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, check=True, timeout=120)
