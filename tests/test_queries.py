"""Every registered query against its SQL statement, over the whole tables."""

from dataclasses import replace

import pytest
from compare import connect, difference

import __spark_entry__ as driver
from admeter import queries
from admeter.queries import REGISTRY
from oracles import sql

SF_DIR = "/root/testdata/sf0.001"
SQL = sql.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(SQL) == set(REGISTRY)
    assert set(REGISTRY) <= set(driver.queries()) and SQL.items() <= driver.oracle_sql().items()


# What no plan over whole tables may contain; the stream queries read what a stream wrote.
UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "InPandas", "ArrowEvalPython", "BatchEvalPython"
)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, db, name):
    df = REGISTRY[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in UNWANTED if operator in plan]
    assert difference(df, db, SQL[name]) is None


@pytest.mark.parametrize("name", [
    "enriched_events", "dedup_ttl", "click_to_basket", "late_upsert", "lake_upsert", "late_events", "dlq_stats", "series_requests",
])
def test_query_when_every_key_is_hot(spark, db, name, monkeypatch):
    """The same rows when all thresholds are low: other plans, nothing left out."""
    low = replace(queries.SETTINGS, hot_key_rows=3, hot_key_sample=1.0, broadcast_rows=2, hot_span_ms=60_000)
    monkeypatch.setattr(queries, "SETTINGS", low)
    assert difference(REGISTRY[name](spark, SF_DIR), db, SQL[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
