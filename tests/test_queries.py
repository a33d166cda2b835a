"""Every registered query against its SQL oracle, and the shape of its plan."""

import pytest

import __spark_entry__ as registry
from cinderframe.checks import AREAS
from cinderframe.checks.tables import normal_rows, oracle_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: registry.oracle_sql()[name] for name in QUERIES if name in registry.oracle_sql()}
# Keyed state runs in Python workers; nothing else does.
PYTHON_STATE = {"stream_retry", "stream_snapshot_changes"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_oracle_without_nested_loops_or_python(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in plan
    got = normal_rows(df.columns, df.collect())
    assert got == normal_rows(*oracle_rows(FOLDER, ORACLES[name]))
    assert got[1], "no rows: the check would prove nothing"


def test_entry(spark):
    assert registry.entry(spark).count() > 0
