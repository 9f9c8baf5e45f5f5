import pytest

from admeter.config import DAY_MS, HOUR_MS, Settings
from admeter.operators import aggregates as A
from admeter.plans import serving as V
from admeter.plans.serving import Request, Stores

S = Settings()
NOW = S.as_of_ms


def event(at, **more):
    return dict(tenant_id="t", campaign_id="c", event_type="CLICK", event_timestamp_ms=at, **more)


@pytest.fixture
def stores(events):
    def make(rows, hot_rows=None):
        df = events(rows)
        hot = events(hot_rows) if hot_rows is not None else df
        return Stores(A.hot_counters(hot, S), A.hot_hourly_series(hot, S), df, df)

    return make


def iso(ms):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_tier_bounds_are_inclusive():
    assert V.resolve_tier(None, S) == "hot"
    assert V.resolve_tier(NOW - 48 * HOUR_MS, S) == "hot"
    assert V.resolve_tier(NOW - 48 * HOUR_MS - 1, S) == "warm"
    assert V.resolve_tier(NOW - 30 * DAY_MS, S) == "warm"
    assert V.resolve_tier(NOW - 30 * DAY_MS - 1, S) == "cold"


def test_request_checks():
    Request("t", "c", "CLICK").check()
    Request("t", "c", "CLICK").check(set())  # an empty list allows everything
    with pytest.raises(PermissionError):
        Request(" ", "c", "CLICK").check()
    with pytest.raises(ValueError):
        Request("t", "c c", "CLICK").check()
    with pytest.raises(ValueError):
        Request("t", "c", "CLICK", grain="HOUR").check()
    with pytest.raises(ValueError):
        Request("t", "c", "CLICK", placement="a/b").check()
    with pytest.raises(PermissionError):
        Request("t", "c", "CLICK").check({"other"})


def test_default_window():
    assert Request("t", "c", "CLICK").window(S) == (NOW - 2 * HOUR_MS, NOW)
    assert Request("t", "c", "CLICK", "nonsense", iso(NOW - DAY_MS)).window(S) == (
        NOW - DAY_MS - 2 * HOUR_MS, NOW - DAY_MS)


def test_count_falls_back_to_warm(stores):
    both = stores([event(NOW - HOUR_MS), event(NOW - 2 * HOUR_MS)], [event(NOW - HOUR_MS)])
    assert V.tiered_count(both, Request("t", "c", "CLICK"), S).first().cnt == 1
    cold_cache = stores([event(NOW - HOUR_MS)], [])
    assert V.tiered_count(cold_cache, Request("t", "c", "CLICK"), S).first().cnt == 1
    assert V.tiered_count(cold_cache, Request("t", "c", "PURCHASE"), S).first().cnt == 0


def test_hot_and_warm_counts_ignore_the_start(stores):
    s = stores([event(NOW - 20 * DAY_MS), event(NOW - HOUR_MS)])
    assert V.tiered_count(s, Request("t", "c", "CLICK", iso(NOW - 3 * DAY_MS)), S).first().cnt == 2
    assert V.tiered_count(s, Request("t", "c", "CLICK", iso(NOW - 31 * DAY_MS)), S).first().cnt == 2


def test_series_of_the_hot_tier(stores):
    s = stores([event(NOW - HOUR_MS + 5), event(NOW - HOUR_MS + 6)])
    rows = V.metric_response(s, Request("t", "c", "CLICK"), S).collect()
    assert [(r.bucket, r.value, r.total, r.source, r.metric) for r in rows] == [
        (iso(NOW - HOUR_MS), 2, 2, "hot", "click")]


def test_series_falls_back_to_an_even_split(stores):
    s = stores([event(NOW - 5 * DAY_MS + i) for i in range(7)], [])
    rows = V.metric_response(s, Request("t", "c", "CLICK"), S).orderBy("bucket").collect()
    assert [r.value for r in rows] == [2, 2, 3] and rows[0].total == 7


def test_cold_series_has_no_fallback(stores):
    s = stores([event(NOW - HOUR_MS)])
    old = Request("t", "c", "CLICK", iso(NOW - 60 * DAY_MS), iso(NOW - 59 * DAY_MS))
    assert V.tiered_series(s, old, S).count() == 0


def test_placement_filters(stores):
    s = stores([event(NOW - 4 * DAY_MS, placement_id="p"), event(NOW - 4 * DAY_MS, placement_id="q")])
    ask = lambda p: V.tiered_series(s, Request("t", "c", "CLICK", iso(NOW - 5 * DAY_MS), None, "day", p), S)
    assert ask("p").first().value == 1 and ask(None).first().value == 2


def test_exists(stores, spark):
    s = stores([event(NOW - HOUR_MS), event(NOW - 3 * DAY_MS, ) | {"campaign_id": "old"}])
    asked = spark.createDataFrame([("t", "c"), ("t", "old"), ("u", "c")], "tenant_id string, campaign_id string")
    got = {(r.tenant_id, r.campaign_id): r.in_hot for r in V.exists_in_hot(s, asked).collect()}
    assert got == {("t", "c"): True, ("t", "old"): False, ("u", "c"): False}
