"""Every registered query against its SQL, and what its plan must not hold."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from souklens.sources.market import Market
from souklens.workload import ORACLES, QUERIES, register_views
from tests.compare import difference

SF = "/root/testdata/sf0.001"
#: No Python per row, no product of tables, nothing gathered by a nested loop.
FORBIDDEN = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    assert difference(df, con, ORACLES[name]) is None


def test_entry(spark):
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    df = entry.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 17


def test_comparison_notices_a_wrong_value(spark, con):
    df = entry.queries()["dim_geography"](spark, SF)
    assert difference(df, con, entry.oracle_sql()["dim_geography"]) is None
    wrong = df.withColumn("total_users", df["total_users"] + (df["total_orders"] > 60).cast("int"))
    assert difference(wrong, con, entry.oracle_sql()["dim_geography"]) is not None
    assert difference(df.limit(3), con, entry.oracle_sql()["dim_geography"]) is not None


def test_datasets_are_open_to_sql(spark):
    register_views(Market(spark, SF), ["dim_geography", "cons_user_subscription"])
    rows = spark.sql("""
        SELECT g.country_code, any_value(total_users) AS users, count(DISTINCT user_id) AS subscribers
        FROM dim_geography g JOIN cons_user_subscription s ON s.country_code = g.country_code GROUP BY 1""").collect()
    assert rows and all(r.subscribers <= r.users for r in rows)
