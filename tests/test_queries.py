"""Every registered query against its SQL on the smallest data set."""

import glob
import os

import pytest

import __spark_entry__ as driver
from depot.workloads.registry import all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert all_queries().keys() <= driver.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("NestedLoop", "CartesianProduct", "EvalPython", "ExistingRDD"):
        assert node not in plan
    columns = sorted(df.columns)
    got = sorted((repr(tuple(r)) for r in df.select(*columns).collect()))
    result = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert got == want


def test_expanded_matrix_is_not_sorted(spark):
    df = driver.queries()["definition_expand"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = {name: [line.index(name) for line in plan if name in line] for name in ("Generate", "Sort [", "HashAggregate")}
    # a sort takes what equal rows were counted to, not the exploded rows
    assert len(depth["HashAggregate"]) == 2 and max(depth["Sort ["]) < min(depth["HashAggregate"]) < min(depth["Generate"])


def test_flagship_query(spark):
    assert not driver.entry(spark).isEmpty()
