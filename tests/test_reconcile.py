import pytest

from admeter.config import DAY_MS, HOUR_MS, Settings
from admeter.operators import reconcile as R

KEY = ("t", "c", "CLICK")
SCHEMA = "tenant_id string, campaign_id string, event_type string, cnt bigint"
S = Settings()


@pytest.fixture
def counts(spark):
    return lambda *rows: spark.createDataFrame([(*KEY, n) for n in rows], SCHEMA)


def report(results, settings=S, window="hourly"):
    return R.report(results, window, 0, 1, 1, settings).first()


@pytest.mark.parametrize(
    "warm, hot, delta, pct, patched, status",
    [
        (100, [100], 0, 0.0, False, "OK"),
        (150, [100], -50, 100 / 3, True, "DISCREPANCIES_FOUND"),
        (100, [120], 20, 20.0, False, "DISCREPANCIES_FOUND"),
        (500, [], -500, 100.0, True, "DISCREPANCIES_FOUND"),
        (1000, [999], -1, 0.1, True, "OK"),
    ],
)
def test_hourly(counts, warm, hot, delta, pct, patched, status):
    h = counts(*hot)
    results = R.hourly_results(counts(warm), h, S)
    (r,) = results.collect()
    assert (r.delta, r.auto_patched, r.reference_store, r.observed_store) == (delta, patched, "warm", "hot")
    assert r.discrepancy_pct == pytest.approx(pct)
    row = report(results)
    assert (row.status, row.campaigns, row.discrepancies) == (status, 1, int(delta != 0))
    assert R.patched_counters(h, results).first().cnt == max(warm, *(hot or [0]))


def test_auto_correct_off(counts):
    off = Settings(auto_correct=False)
    h = counts(10)
    results = R.hourly_results(counts(100), h, off)
    assert results.first().auto_patched is False
    assert R.patched_counters(h, results).first().cnt == 10


def test_empty(counts):
    row = report(R.hourly_results(counts(), counts(5), S))
    assert (row.status, row.campaigns, row.auto_patched) == ("OK", 0, 0)


@pytest.mark.parametrize(
    "warm, cold, rows, delta, status",
    [(1000, [1000], 1, 0, "OK"), (950, [1000], 1, -50, "DISCREPANCIES_FOUND"), (500, [], 0, None, "OK")],
)
def test_daily(counts, warm, cold, rows, delta, status):
    results = R.daily_results(counts(warm), counts(*cold))
    got = results.collect()
    assert len(got) == rows and report(results).status == status
    if got:
        assert got[0].delta == delta and got[0].reference_store == "cold"


def test_pct_of_missing_reference(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 0), (0, 5), (10, 8)], "r bigint, o bigint")
    got = df.select(R.discrepancy_pct(F.col("r"), F.col("o") - F.col("r")).alias("p")).collect()
    assert [g.p for g in got] == [0.0, 100.0, 20.0]


def test_windows_are_half_open(events):
    as_of = 3 * DAY_MS + 5 * HOUR_MS
    settings = Settings(as_of_ms=as_of)
    day = 2 * DAY_MS
    df = events([dict(tenant_id="t", campaign_id="c", event_type="CLICK", event_timestamp_ms=t)
                 for t in (day - 1, day, day + DAY_MS - 1, day + DAY_MS)])
    assert R.daily(df, df, settings).first().reference_count == 2
    recent = events([dict(tenant_id="t", campaign_id="c", event_type="CLICK", event_timestamp_ms=t)
                     for t in (as_of - 2 * HOUR_MS - 1, as_of - 2 * HOUR_MS, as_of)])
    from admeter.operators.aggregates import hot_counters

    (r,) = R.hourly(recent, hot_counters(recent, settings), settings).collect()
    assert (r.reference_count, r.observed_count) == (1, 3)


@pytest.fixture
def reports(spark):
    def make(n, window="hourly"):
        rows = [(window, f"{window}:{i}", "OK", i, 1, 0, 0) for i in range(n)]
        return spark.createDataFrame(
            rows,
            "window string, run_id string, status string, run_time_ms bigint, campaigns bigint, "
            "discrepancies bigint, auto_patched bigint",
        )

    return make


def test_store_order_and_cap(reports):
    two = R.newest(reports(2), 10, S).orderBy("position").collect()
    assert [r.run_time_ms for r in two] == [1, 0]
    kept = R.retained(reports(51), S)
    assert kept.count() == 48 and kept.agg({"run_time_ms": "min"}).first()[0] == 3
    assert R.newest(reports(51), 0, S).count() == 1  # the limit is at least 1
    assert R.newest(reports(51), 1000, S).count() == 48


def test_status_without_runs(reports):
    got = {r.window: (r.status, r.run_id, r.campaigns) for r in R.status(reports(3)).collect()}
    assert got == {"hourly": ("OK", "hourly:2", 1), "daily": ("NO_RUN_YET", None, 0)}


def test_failed_run(spark, reports, counts):
    failed = R.failed_report(spark, "daily", 10, 15, 15, "no table")
    ok = R.report(R.daily_results(counts(1), counts(1)), "daily", 0, 1, 1, S)
    both = ok.unionByName(failed)
    assert {r.status for r in both.collect()} == {"OK", "ERROR"}
    results = R.daily_results(counts(1), counts(1)).selectExpr("'daily' AS window", "*")
    m = R.run_metrics(both, results).first()
    assert (m.runs, m.errors, m.discrepancies) == (2, 1, 0)
