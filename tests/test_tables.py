"""Written tables."""

import os
from types import SimpleNamespace

import pytest
from conftest import rows_of

from buildscope.plans import tables
from buildscope.plans.quantiles import overall_quantiles
from buildscope.sources import tables as sinks


@pytest.fixture
def sides(spark):
    rows = spark.createDataFrame(
        [("hot", i) for i in range(50)] + [(f"k{i % 7}", i) for i in range(10)] + [(None, 1), ("lost", 2)],
        "k string, v int",
    )
    stats = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", 2.0) for i in range(9)], "k string, s double")
    return rows, stats


def test_materialize_cuts_the_plan(sides):
    written = tables.materialize(sides[0].groupBy("k").count())
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "parquet" in plan.lower()
    assert rows_of(written) == rows_of(sides[0].groupBy("k").count())


def test_folder_is_the_one_the_session_names(spark):
    assert tables.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("master", ["local[2]", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_only_a_session_in_one_process_may_name_no_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(applicationId=master, master=master))
    if master == "local[2]":
        assert tables.shared_dir(session) == tables.shared_dir(session)
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session)


def test_release_deletes_what_was_written(sides):
    written = tables.materialize(sides[0])
    path = written._scratch_path
    assert written.count() == sides[0].count() and os.path.isdir(path)
    tables.release(written, None, sides[1])
    assert not os.path.exists(path)


def test_a_written_table_of_many_models_is_read_in_part(spark, tmp_path):
    """The number of files does not follow the number of models, and of one model few pages are read."""
    path, models, rows = str(tmp_path / "t"), 800, 100
    table = spark.range(models * rows).selectExpr(f"concat('model_', id % {models}) AS model_id", "id AS v")
    sinks.save_by_model(table, path)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 4
    one = spark.read.parquet(path).filter("model_id = 'model_7'")
    assert len(one.collect()) == rows
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert rows <= leaf.metrics().get("numOutputRows").get().value() < models * rows / 2
    assert spark.read.parquet(path).filter("model_id = 'none'").count() == 0


def test_quantiles_over_all_rows(spark):
    rows = spark.createDataFrame([(float(v), None) for v in (4, 1, 3, 2)] + [(None, None)], "a double, b double")
    found = overall_quantiles(rows, ["a", "b"], [0.5, 0.95])
    assert tuple(rows.limit(1).select(*[found[n] for n in ("a_q0.5", "a_q0.95", "b_q0.5")]).first()) == (2.5, pytest.approx(3.85), None)
    none = overall_quantiles(rows.limit(0), ["a"], [0.5])
    assert rows.limit(1).select(none["a_q0.5"]).first()[0] is None
