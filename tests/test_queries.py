"""Every registered query against its DuckDB twin, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from forgetide.plans import ORACLES, QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    problem, _ = differences(frame, duck, ORACLES[name])
    assert problem is None, problem
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["project", "period", "n"]
