import pytest
from pyspark.sql import functions as F

from admeter.functions import events as E
from admeter.functions import privacy
from admeter.operators import aggregates as A


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, "UNSPECIFIED"), ("", "UNSPECIFIED"), (" click\t", "CLICK"), ("Add_To_Cart", "ADD_TO_CART"),
        ("NOT_A_TYPE", "UNSPECIFIED"), ("unspecified", "UNSPECIFIED"), (" CLICK", "UNSPECIFIED"),
        ("\x00CLICK\x1f", "CLICK"), ("CLICK_TO_BASKET", "CLICK_TO_BASKET"),
    ],
)
def test_normalize_type(spark, raw, want):
    assert one(spark, raw, E.normalize_type) == want


@pytest.mark.parametrize(
    "text, want",
    [(None, True), ("", True), (" \t\n", True), (" 　", True), (" ", False), (" a ", False),
     ("a\n", False), ("\x1c", True)],
)
def test_is_blank(spark, text, want):
    assert one(spark, text, E.is_blank) is want


def test_mask(spark):
    text = "user jane.doe@example.com from 192.168.10.5 clicked"
    assert one(spark, text, privacy.mask) == "user ***@*** from ***.***.***.*** clicked"
    assert one(spark, None, privacy.mask) is None
    assert one(spark, "", privacy.mask) == ""
    assert one(spark, "v1.2.3.4.5 x1.2.3.4 é1.2.3.4", privacy.mask) == "v1.***.***.***.*** x1.2.3.4 é***.***.***.***"
    assert one(spark, "no 1.2 here", privacy.mask) == "no 1.2 here"


def test_pseudonym(spark):
    a, b = (one(spark, "user-42", privacy.pseudonymize) for _ in range(2))
    assert a == b and a.startswith("anon_") and len(a) == 17
    assert one(spark, None, privacy.pseudonymize) is None
    assert one(spark, "  ", privacy.pseudonymize) == "  "


def reason(events, **fields):
    base = dict(event_id="e", user_id="u", session_id="s", event_type="CLICK")
    return events([{**base, **fields}]).select(E.rejection_reason().alias("r")).first().r


def test_rejection_reasons(events):
    assert reason(events) is None
    assert reason(events, event_id=" ", user_id=None) == "Missing required field: eventId"
    assert reason(events, user_id="") == "Missing required field: userId"
    assert reason(events, session_id=None) == "Missing required field: sessionId"
    assert reason(events, event_type="NOT_A_TYPE") == "Unrecognized or missing eventType: NOT_A_TYPE"
    assert reason(events, event_type=None) == "Unrecognized or missing eventType: null"


def test_field_errors(events):
    row = dict(event_id="", user_id="u" * 129, session_id="s", event_type=" ", cost=-0.5, campaign_id="c" * 129)
    got = events([row]).select(E.field_errors().alias("e")).first().e
    assert got == [
        "eventId is required", "userId must not exceed 128 characters",
        "campaignId must not exceed 128 characters", "eventType is required", "cost must be non-negative",
    ]


def test_valid_matches_reason(events):
    rows = [
        dict(event_id=i, user_id=u, session_id=s, event_type=t)
        for i in ("e", " ") for u in ("u", None) for s in ("s", "") for t in ("click", "x", None)
    ]
    got = events(rows).select(E.is_valid().alias("v"), E.rejection_reason().alias("r")).collect()
    assert all(g.v == (g.r is None) for g in got) and any(g.v for g in got)


def test_abbreviate(spark):
    assert one(spark, "x" * 80, E.abbreviate) == "x" * 80
    assert one(spark, "x" * 81, E.abbreviate) == "x" * 77 + "..."
    assert one(spark, None, E.abbreviate) == "unknown"


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-01T00:00:01Z", 1704067201000), ("2024-01-01T00:00:01.250Z", 1704067201250),
        ("2024-01-01T02:00:01+02:00", 1704067201000), ("2024-01-01", None), ("", None), (None, None),
        ("2024-13-01T00:00:00Z", None), ("soon", None), ("2024-01-01 00:00:01Z", None),
    ],
)
def test_parse_instant(spark, text, want):
    from admeter.plans.serving import instant_ms

    assert one(spark, text, E.parse_instant_ms) == want
    assert instant_ms(text) == want


def test_buckets(spark):
    assert one(spark, -1, E.hour_bucket, "bigint") == 0  # truncates toward zero
    assert one(spark, 7_200_001, E.hour_bucket, "bigint") == 7_200_000
    assert one(spark, -1, lambda c: E.truncate_ms(c, "day"), "bigint") == -86_400_000


def test_default_event_time(spark):
    assert one(spark, 0, lambda c: E.default_event_time(c, 9), "bigint") == 9
    assert one(spark, 5, lambda c: E.default_event_time(c, 9), "bigint") == 5


def test_ids(spark):
    assert one(spark, "camp_1.A:b-c", E.valid_id) is True
    assert one(spark, "camp 1", E.valid_id) is False
    assert one(spark, "x" * 129, E.valid_id) is False
    assert one(spark, "ok\n", E.valid_id) is False
    assert one(spark, None, E.valid_id) is False


def test_formats(spark):
    assert one(spark, 1704067201000, E.iso_instant, "bigint") == "2024-01-01T00:00:01Z"
    assert one(spark, 1704067201005, E.iso_instant, "bigint") == "2024-01-01T00:00:01.005Z"
    assert one(spark, 12.34567, E.pct_text, "double") == "12.3457"


def test_hot_counter_lifetime(events):
    """A key that rests for more than the TTL starts again from zero."""
    from admeter.config import HOUR_MS, Settings

    def row(at, campaign="c", kind="CLICK"):
        return dict(tenant_id="t", campaign_id=campaign, event_type=kind, event_timestamp_ms=at * HOUR_MS)

    settings = Settings(as_of_ms=100 * HOUR_MS)
    df = events([row(0), row(1), row(60), row(60, kind="IMPRESSION"), row(99), row(52, "exact"), row(4, "exact"),
                 row(51, "dead"), dict(tenant_id="t", event_type="CLICK", event_timestamp_ms=99 * HOUR_MS)])
    got = {(r.campaign_id, r.event_type): r.cnt for r in A.hot_counters(df, settings).collect()}
    assert got == {("c", "CLICK"): 2, ("c", "IMPRESSION"): 1, ("exact", "CLICK"): 2}
    series = {(r.event_type, r.bucket_ms // HOUR_MS) for r in A.hot_hourly_series(df, settings)
              .where("campaign_id = 'c'").collect()}
    assert series == {("CLICK", 60), ("CLICK", 99), ("IMPRESSION", 60)}


def test_cube_lookup(events):
    df = events([dict(event_id=str(i), tenant_id="t", campaign_id=c, event_type="CLICK", placement_id=p, cost=0.1)
                 for i, (c, p) in enumerate([("a", "x"), ("a", None), ("b", "x")])])
    cube = A.cube_placement(df)
    by_campaign = A.cube_lookup(cube, A.PLACEMENT_DIMS, tenant_id="t", campaign_id="a").collect()
    assert [(r.cnt, r.sum_cost) for r in by_campaign] == [(2, 0.2)]
    assert A.cube_lookup(cube, A.PLACEMENT_DIMS).first().cnt == 3
    assert A.cube_lookup(cube, A.PLACEMENT_DIMS, placement_id="x").first().cnt == 2


def test_authorized(spark):
    rows = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a")], "tenant_id string, campaign_id string")
    grants = spark.createDataFrame([("t1", "a"), ("t1", "a")], "tenant_id string, campaign_id string")
    got = sorted(tuple(r) for r in A.authorized(rows, grants).collect())
    assert got == [("t1", "a"), ("t2", "a")]
