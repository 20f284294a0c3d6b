"""Every registered query against its SQL twin, and what its plan must not contain."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from sqlweave.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()

_spec = importlib.util.spec_from_file_location("check_queries", Path(__file__).parents[1] / "tools" / "check_queries.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    build, sql = QUERIES[name]
    seen = []

    def once(session, sf_dir):
        seen.append(build(session, sf_dir))
        return seen[0]

    ok, detail = check.compare(spark, con, SF, name, once, sql)
    assert ok, detail
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan, f"{operator} in the plan of {name}"
