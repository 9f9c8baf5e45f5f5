"""The split path gives what a plain window gives, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.operators import hot_keys as H
from admeter.operators import ordered

ORDER = ["t", "seq"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(2000):
        x = rng.random()
        key = "hot" if x < 0.4 else None if x < 0.5 else f"k{rng.randrange(80)}"
        rows.append((key, rng.choice([7, rng.randrange(1000)]), seq, rng.randrange(10**6)))
    return spark.createDataFrame(rows, "k string, t bigint, seq bigint, v bigint")


@pytest.fixture(params=[(10**9, 10), (100, 1000), (10, 1000), (10, 2)])
def settings(request):
    rows, small = request.param
    return Settings(hot_key_rows=rows, hot_key_sample=1.0, broadcast_rows=small, hot_span_ms=50)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.fixture(params=[10**9, 100, 7, 1])
def width(request):
    return request.param


def test_row_number(table, width):
    got = ordered.row_number(table, ["k"], ORDER, "n", width)
    w = Window.partitionBy("k").orderBy(*ORDER)
    same(got, table.withColumn("n", F.row_number().over(w).cast("bigint")))


def test_running_max_before(table, width):
    got = ordered.running_max_before(table, ["k"], ORDER, "v", "m", width)
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    same(got, table.withColumn("m", F.max("v").over(w)))


def test_previous_row_in_spans(table, width):
    odd, value = F.col("v") % 7 == 0, F.struct("seq", "v")
    got = ordered.previous_match(table, ["k"], ORDER, odd, value, "p", width)
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    same(got, table.withColumn("p", F.last(F.when(odd, value), ignorenulls=True).over(w)))


def test_null_order_comes_first(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 3, 2), (None, None, 3), (None, 1, 4), ("a", None, 5)], "k string, t long, seq long")
    got = {r.seq: r.n for r in ordered.row_number(df, ["k"], ORDER, "n", 2).collect()}
    assert got == {1: 1, 5: 2, 2: 3, 3: 1, 4: 2}


def test_no_job_runs_and_nothing_is_written_while_a_plan_is_built(spark, table):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    df = ordered.row_number(table, ["k"], ORDER, "n", 10)
    df._jdf.queryExecution().optimizedPlan()
    assert list(tracker.getJobIdsForGroup("building")) == []


def test_previous_match(table, settings):
    hot = H.find_hot(table, ["k"], settings)
    odd, value = F.col("v") % 7 == 0, F.struct("seq", "v")
    got = H.previous_match(table, ["k"], ORDER, odd, value, "p", settings, hot)
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    same(got, table.withColumn("p", F.last(F.when(odd, value), ignorenulls=True).over(w)))


def test_find_hot(table):
    found = H.find_hot(table, ["k"], Settings(hot_key_rows=150, hot_key_sample=1.0))
    assert {r.k for r in found.table.collect()} == {"hot", None}
    assert found.keys == 2 and found.rows > 800


def test_find_hot_each(table):
    by_key, by_time, none = H.find_hot_each(
        table, [["k"], ["t"], ["seq"]], Settings(hot_key_rows=150, hot_key_sample=1.0)
    )
    assert by_key.keys == 2 and none is None
    assert [r.t for r in by_time.table.collect()] == [7]
