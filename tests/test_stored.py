"""Stored aggregates against the same answers counted from events."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from admeter.config import DAY_MS, HOUR_MS, MINUTE_MS, Settings
from admeter.model import COUNT_KEYS
from admeter.operators import aggregates as A
from admeter.plans import serving, stored
from admeter.sources import lake

S = Settings()
NOW = S.as_of_ms
KEY = ("t0", "c0", "CLICK")


def made(n=600):
    rnd = random.Random(2)
    for i in range(n):
        yield dict(
            event_id=f"e{i}", seq=i, tenant_id=f"t{i % 2}", campaign_id=rnd.choice(["c0", "c1", None]),
            event_type=rnd.choice(["CLICK", "IMPRESSION"]), placement_id=rnd.choice(["p", "q"]), cost=rnd.random(),
            geo_country=rnd.choice(["US", None]), device_type="web",
            event_timestamp_ms=NOW - rnd.randrange(6 * DAY_MS if i % 3 else 90 * MINUTE_MS))


@pytest.fixture(scope="module")
def table(spark, events, tmp_path_factory):
    df = events(list(made())).cache()
    tables = stored.Tables(spark, str(tmp_path_factory.mktemp("stored")))
    for n in range(5):
        tables.add(df.where(F.col("seq") % 5 == n), f"batch-{n}")
    tables.add(df.where(F.col("seq") % 5 == 4), "batch-4")  # a batch runs again
    return df, tables


def same(a, b):
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def check(df, tables):
    own = serving.Stores(A.hot_counters(df, S), A.hot_hourly_series(df, S), df, df)
    kept = stored.StoredStores(tables, S)
    same(kept.hot_counts(), own.hot_counts())
    same(kept.hot_points(), own.hot_points())
    same(kept.warm_counts(), own.warm_counts())
    same(kept.day_counts(NOW), own.day_counts(NOW))
    for placement in (None, "p"):
        same(kept.warm_count(KEY, placement), own.warm_count(KEY, placement))
        for a, b in ((NOW - DAY_MS + 17, NOW - 5), (NOW - HOUR_MS, NOW), (NOW - 30_000, NOW - 20_000), (NOW - 61_000, NOW - 1)):
            for grain in ("minute", "hour", "day"):
                same(kept.warm_series(KEY, placement, a, b, grain), own.warm_series(KEY, placement, a, b, grain))
    same(kept.cold_count(KEY, NOW - 3 * DAY_MS, NOW), own.cold_count(KEY, NOW - 3 * DAY_MS, NOW))
    assert kept.warm_count(("t0", "none", "CLICK")).first().cnt == 0


def test_tables_of_a_batch_are_written_at_the_same_time(events, spark, tmp_path, monkeypatch):
    """The lake's write waits here for the roll-up's, which began only after it before."""
    began, append = threading.Event(), lake.append
    sums = A.minute_sums

    def waiting(*args):
        assert began.wait(60)
        append(*args)

    def minutes(rows):
        began.set()
        return sums(rows)

    monkeypatch.setattr(lake, "append", waiting)
    monkeypatch.setattr(A, "minute_sums", minutes)
    tables = stored.Tables(spark, str(tmp_path))
    tables.add(events(list(made(20))), "batch-0")
    assert lake.whole(spark, tables.lake).count() == 20

    def failing(*args):
        raise OSError("disk")

    monkeypatch.setattr(lake, "append", failing)
    with pytest.raises(OSError, match="disk"):
        tables.add(events(list(made(20))), "batch-1")


def test_folders_are_listed_by_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism


def test_stored_answers_equal_counted_ones(table):
    check(*table)


def test_cubes_by_the_smallest_level(table):
    df, tables = table
    by = A.cube_sums(A.minute_sums(df), A.PLACEMENT_DIMS)
    whole = tables.placement.read().where("level = 0").drop("level")
    same(whole, by.where("level = 0").select(*whole.columns))
    rows = stored.cube_rows(tables.placement, A.PLACEMENT_DIMS, ["campaign_id"], tenant_id="t1")
    same(rows.drop("cost"), df.where("tenant_id = 't1'").groupBy("campaign_id").agg(F.count("*").alias("cnt")))
    files = rows.inputFiles()
    assert files and all("level=3/tenant_id=t1" in f for f in files)
    # with that level gone, a finer one answers
    tables.placement.parts.drop(lambda v: v["level"] == "3")
    finer = stored.cube_rows(tables.placement, A.PLACEMENT_DIMS, ["campaign_id"], tenant_id="t1")
    same(finer.drop("cost"), rows.drop("cost"))
    assert all("level=2/" in f or "level=1/" in f for f in finer.inputFiles())
    with pytest.raises(LookupError):
        tables.geo.parts.drop(lambda v: True)
        stored.cube_rows(tables.geo, A.GEO_DIMS, ["tenant_id"])


def test_reads_open_one_tenant_and_its_dates(table):
    _, tables = table
    kept = stored.StoredStores(tables, S)
    series = kept.warm_series(KEY, None, NOW - 2 * DAY_MS + 7, NOW - DAY_MS, "hour")
    files = series.inputFiles()
    days = {lake.day_text(NOW - 2 * DAY_MS), lake.day_text(NOW - DAY_MS)}
    assert files and all("tenant_id=t0" in f and any(d in f for d in days) for f in files)
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "event_date" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert all("tenant_id=t0" in f for f in kept.hot_counts("t0").inputFiles())


def test_compaction_bounds_the_deltas(table, spark):
    df, tables = table
    tables.compact(S, NOW - 20 * DAY_MS, most=2)
    for name in ("rollup", "hours", "placement"):
        per = {}
        for e in getattr(tables, name).parts.live():
            per[e["folder"]] = per.get(e["folder"], 0) + 1
        assert per and max(per.values()) <= 2
    tables.add(df.where("seq < 0"), "nothing")
    own = serving.Stores(A.hot_counters(df, S), A.hot_hourly_series(df, S), df, df)
    kept = stored.StoredStores(tables, S)
    same(kept.hot_counts(), own.hot_counts())
    same(kept.hot_points(), own.hot_points())
    same(kept.warm_series(KEY, None, NOW - 5 * DAY_MS + 3, NOW - 9, "hour"), own.warm_series(KEY, None, NOW - 5 * DAY_MS + 3, NOW - 9, "hour"))


def test_dead_counters_go_with_a_compaction(spark, events, tmp_path):
    tables = stored.Tables(spark, str(tmp_path))
    base = dict(tenant_id="t", event_type="CLICK")
    for n in range(60):
        one = dict(base, event_id=f"e{n}", campaign_id="live", event_timestamp_ms=NOW - (60 - n) * HOUR_MS, seq=n)
        old = dict(base, event_id=f"o{n}", campaign_id="dead", event_timestamp_ms=NOW - (300 - n) * HOUR_MS, seq=n)
        tables.hours.add(A.hourly(events([one, old])), f"batch-{n}")
        if n % 9 == 8:
            tables.hours.compact(stored.MOST_DELTAS, lambda rows: stored.alive(rows, S, NOW - (60 - n) * HOUR_MS))
    live = tables.hours.parts.live()
    assert len(live) <= stored.MOST_DELTAS + 1
    kept = stored.StoredStores(tables, S)
    assert [tuple(r) for r in kept.hot_counts().select(*COUNT_KEYS, "cnt").collect()] == [("t", "live", "CLICK", 60)]


def joined_rows(plan):
    """Rows that all joins of an executed plan made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0
    return own + sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_requests_meet_no_more_rows_than_their_length_has(spark, events, tmp_path):
    """A day with many events of a key, in minutes with many dimensions, and many requests for that day."""
    start = NOW - 6 * DAY_MS
    rows = [
        dict(event_id=f"e{i}", seq=i, tenant_id="t0", campaign_id="c0", event_type="CLICK", cost=0.0, placement_id=f"p{i % 7}",
             event_timestamp_ms=start + i * 40_000) for i in range(2000)
    ]
    tables = stored.Tables(spark, str(tmp_path))
    tables.add(events(rows), "all")
    n, hour = 50, HOUR_MS
    asked = [(i, *KEY[:2], "CLICK", start + hour + i * 7_001, start + 20 * hour + i * 7_001, "hour") for i in range(n)]
    table = spark.createDataFrame(asked, "request long, tenant_id string, campaign_id string, metric string, from_ms long, to_ms long, grain string")
    found = stored.series_table(stored.StoredStores(tables, S), table, S)
    total = sum(r.value for r in found.collect())
    assert total == sum(a <= r["event_timestamp_ms"] <= b for r in rows for *_, a, b, _ in asked)
    assert joined_rows(found._jdf.queryExecution().executedPlan()) < n * 300
