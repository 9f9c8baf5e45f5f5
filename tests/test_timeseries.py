import math

import numpy as np
from pyspark.sql import functions as F

from admeter.config import DAY_MS, HOUR_MS, MINUTE_MS, Settings
from admeter.operators import monitoring, rate_limit
from admeter.operators import timeseries as S
from admeter.operators.quantiles import quantiles


def arrays(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_spine(spark):
    make = lambda a, b, g, cap=10_000: arrays(spark, S.spine(F.lit(a), F.lit(b), g, cap))
    assert make(HOUR_MS + 5, 3 * HOUR_MS, "hour") == [HOUR_MS, 2 * HOUR_MS, 3 * HOUR_MS]
    assert make(0, 10 * MINUTE_MS, "MINUTE", 3) == [0, MINUTE_MS, 2 * MINUTE_MS]
    assert make(5, 5, "day") == [0]
    assert make(2 * HOUR_MS, HOUR_MS, "hour") == []
    assert len(make(0, 10**15, "minute")) == 10_000
    assert make(0, HOUR_MS, "week") == [0, HOUR_MS]  # unknown grains mean hour


def test_even_split(spark):
    def split(total, a, b, grain="hour"):
        points = arrays(spark, S.even_split(F.lit(total).cast("bigint"), F.lit(a), F.lit(b), grain, 10_000))
        return [(p.bucket_ms // HOUR_MS, p.value) for p in points]

    assert split(10, 0, 2 * HOUR_MS) == [(0, 3), (1, 3), (2, 4)]
    assert split(2, 0, 2 * HOUR_MS) == [(0, 0), (1, 0), (2, 2)]
    assert split(7, 3 * HOUR_MS, 2 * HOUR_MS) == [(2, 7)]


def test_series_bounds(events):
    df = events([dict(event_timestamp_ms=t) for t in (0, 1, HOUR_MS, DAY_MS, DAY_MS + 1)])
    got = lambda s: {r.bucket_ms: r.value for r in s.collect()}
    assert got(S.warm_series(df, 1, DAY_MS, "day")) == {0: 2, DAY_MS: 1}
    assert got(S.cold_series(df, HOUR_MS, DAY_MS, None)) == {0: 2, HOUR_MS: 1, DAY_MS: 2}


def test_rate_limit(events):
    df = events([dict(tenant_id=t, event_timestamp_ms=ms) for t, ms in
                 [("a", 0), ("a", 999), ("a", 1000), ("b", 5), ("b", 6), ("b", 7)]])
    settings = Settings(quota_default=1, quota_window_s=1)
    got = {r.seq: r.admitted for r in rate_limit.admission(df, {"b": 2}, settings).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: False}
    free = rate_limit.admission(df, {}, Settings(quota_default=0, quota_enforced=False))
    assert all(r.admitted for r in free.collect())
    left = {(r.tenant_id, r.window_no): r.remaining for r in rate_limit.remaining(df, {"b": 5}, settings).collect()}
    assert left == {("a", 0): 0, ("a", 1): 0, ("b", 0): 2}


def test_rate_limit_with_one_hot_window(events):
    """A third of all rows in one tenant and window: positions are still 1..n."""
    rows = [dict(tenant_id="hot", event_timestamp_ms=i % 7) for i in range(300)]
    rows += [dict(tenant_id=f"t{i % 50}", event_timestamp_ms=i) for i in range(600)]
    settings = Settings(hot_key_rows=40, hot_key_sample=1.0)
    got = rate_limit.admission(events(rows), {}, settings).where("tenant_id = 'hot'").collect()
    assert sorted(r.position for r in got) == list(range(1, 301))


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.integers(0, 10**6, 500), "b": np.array([7]), "c": rng.integers(0, 3, 100)}
    rows = [(k, int(v)) for k, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    probabilities = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in quantiles(df, ["k"], "v", probabilities, 1000).collect():
        assert r.n == len(groups[r.k])
        for name, p in probabilities.items():
            assert math.isclose(r[name], np.quantile(groups[r.k], p), abs_tol=1e-6)


def test_dead_letter_alert_levels(events):
    df = events([dict(tenant_id="t", event_timestamp_ms=0)] * 300)
    rows = monitoring.dead_letter_rate(df, warning=0.5, critical=1.0).collect()
    assert len(rows) == 5 and all((r.rate, r.warning, r.critical) == (1.0, True, False) for r in rows)


def test_drop_ratio_without_processed_events(events):
    df = events([dict(event_timestamp_ms=0)])
    rows = monitoring.drop_ratio(df, df.where("false")).collect()
    assert all(r.drop_ratio is None and r.alert is False for r in rows)


def test_silent_windows(events, spark):
    span = spark.createDataFrame([(0, 100 * MINUTE_MS)], "from_ms bigint, to_ms bigint")
    df = events([dict(event_timestamp_ms=m * MINUTE_MS) for m in (1, 40, 95)])
    got = {r.window_start_ms // MINUTE_MS: r.alert for r in monitoring.silent_windows(df, span).collect()}
    assert got == {15: False, 45: False, 60: True, 75: True}
