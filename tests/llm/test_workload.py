"""Registered queries against their SQL, and what the contract says of their columns."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from tools.compare import SAME_TYPE, TABLES, canonical

from buildscope.llm.workload import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert {q.split("_")[0] for q in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, expected = QUERIES[name](spark, SF), db.sql(SQL[name])
    assert {c: SAME_TYPE[t] for c, t in found.dtypes} == {c: str(t) for c, t in zip(expected.columns, expected.types)}
    columns = sorted(found.columns)
    order = [expected.columns.index(c) for c in columns]
    assert Counter(tuple(canonical(r[c]) for c in columns) for r in found.collect()) == Counter(tuple(canonical(r[i]) for i in order) for r in expected.fetchall())
