"""Every registered query against its SQL text."""

import pytest
from compare import connect, spark_rows, sql_rows

from stocklens.oracle import ORACLE
from stocklens.registry import QUERIES


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


# Row-at-a-time Python and joins without a key have no place in the plans.
UNWANTED = ["PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"]
# These join a table of one row, which has no key.
ONE_ROW_JOIN = {"type_share", "bounded_customers", "combined_movements_apart", "probing_movement"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, database, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [word for word in UNWANTED if word in plan]
    assert found == (["NestedLoopJoin"] if name in ONE_ROW_JOIN else [])
    ours, theirs = spark_rows(df), sql_rows(database, ORACLE[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    assert ours[1]
