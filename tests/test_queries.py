"""Every query of the engine's operators against its SQL in DuckDB, and the driver's entry point."""

import pytest
from check_sql import connect, differences

import __spark_entry__ as entry_module
from conftest import SF_DIR
from workload.registry import QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = entry_module.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
        assert unwanted not in plan
    ours = frame.toPandas()
    sql = entry_module.oracle_sql().get(name)
    assert sql, f"{name} has no SQL"
    assert differences(ours, duck.execute(sql).df()) is None


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() == 1000
