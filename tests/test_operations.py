"""Alert state, bucket quantiles, run store, replay cursor, request tables and the Avro wire format."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from admeter.config import HOUR_MS, MINUTE_MS, Settings
from admeter.model import WIRE_FIELDS, WIRE_SCHEMA
from admeter.operators import alerts, quantiles, reconcile
from admeter.operators.replay import ReplayStore
from admeter.operators.run_store import RunStore
from admeter.plans import serving, stored
from admeter.sources import avro_wire, kafka

S = Settings()
M = MINUTE_MS


def test_alert_states(spark):
    rule = alerts.Rule("r", 2 * M)
    at = [0, 1, 3, 4, 5, 6, 10, 20, 21, 22, 40]
    rows = spark.createDataFrame([(n * M, "g", True) for n in at] + [(2 * M, "g", False)], "window_start_ms long, g string, on boolean")
    got = alerts.episodes(alerts.held(rows, rule, "on", "g"), 22 * M).orderBy("started_ms").collect()
    assert [(r.started_ms // M, r.fired_ms and r.fired_ms // M, r.resolved_ms and r.resolved_ms // M, r.state) for r in got] == [
        (0, None, 2, "resolved"), (3, 5, 7, "resolved"), (10, None, 11, "resolved"), (20, 22, None, "firing")]
    early = alerts.episodes(alerts.held(rows, rule, "on", "g"), 21 * M)
    assert early.where(f"started_ms = {20 * M}").first().state == "pending"
    assert alerts.episodes(alerts.held(rows.where("false"), rule, "on", "g"), 0).count() == 0


def test_bucket_quantiles(spark):
    bounds = [10, 100, 1000]
    rows = spark.createDataFrame([("a", v) for v in (1, 5, 10, 11, 50, 99, 100, 500)] + [("b", 5000), ("a", None)], "k string, v int")
    parts = [quantiles.histogram(rows.where(f"v % 2 = {n} OR v IS NULL"), ["k"], "v", bounds) for n in (0, 1)]
    found = quantiles.from_histogram(parts[0].unionByName(parts[1]), ["k"], bounds, {"p25": 0.25, "p50": 0.5, "p100": 1.0})
    got = {r.k: r for r in found.collect()}
    # 3 in (0, 10], 4 in (10, 100], 1 in (100, 1000]
    assert got["a"].n == 8 and got["a"].p25 == pytest.approx(10 * 2 / 3)
    assert got["a"].p50 == pytest.approx(10 + 90 / 4) and got["a"].p100 == 1000
    assert got["b"].p50 == 1000  # the open bucket gives the greatest bound


def test_runs_are_measured_and_failures_kept(spark, events, tmp_path):
    store = RunStore(spark, str(tmp_path))
    keys = "tenant_id string, campaign_id string, event_type string, cnt long"
    warm, hot = (spark.createDataFrame([("t", "c", "CLICK", n)], keys) for n in (10, 7))

    def good():
        return reconcile.hourly_results(warm, hot, S, ["tenant_id", "campaign_id", "event_type"])

    def bad():
        raise OSError("store is away\nmore")

    for _ in range(2):  # a run that is done again replaces itself
        store.run("hourly", 0, HOUR_MS, HOUR_MS, S, good)
    store.run("hourly", 0, 2 * HOUR_MS, 2 * HOUR_MS, S, bad)
    reports = {r.run_id: r for r in store.reports().collect()}
    assert len(reports) == 2 and all(r.elapsed_ms > 0 for r in reports.values())
    failed = reports[f"hourly:{2 * HOUR_MS}"]
    assert failed.status == "ERROR" and failed.message == "OSError: store is away"
    found = store.metrics().first()
    assert (found.runs, found.errors, found.discrepancies) == (2, 1, 1)
    store.retain(Settings(reports_kept=1))
    assert [r.run_id for r in store.reports().collect()] == [failed.run_id] and store.results().count() == 0


def test_replay_goes_on_where_it_stopped(spark, events, tmp_path, monkeypatch):
    sent = [dict(event_id=f"e{i}", tenant_id="t", session_id="s", event_type="CLICK", event_timestamp_ms=i) for i in range(20)]
    log = events(sent).withColumns({"partition": F.col("seq").cast("int") % 3, "offset": F.floor(F.col("seq") / 3), "dlq_reason": F.lit("Missing: x")})
    log = kafka.decode_dead_letters(kafka.dead_letter_records(log, ["partition", "offset"]))
    store = ReplayStore(spark, str(tmp_path))
    assert store.run(log, "one", S, requested=7).count() == 7
    assert store.run(log, "one", S, requested=9).count() == 7  # again: nothing new is read
    commit = type(store._parts).commit
    monkeypatch.setattr(type(store._parts), "commit", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        store.run(log, "two", S)
    monkeypatch.setattr(type(store._parts), "commit", commit)
    assert store.everything().count() == 7
    store.run(log, "two", S)
    got = store.everything().select("event_id", "dlq_reason", "replayed").collect()
    assert sorted(r.event_id for r in got) == sorted(f"e{i}" for i in range(20))
    assert {r.dlq_reason for r in got} == {"Missing: x"} and all(r.replayed for r in got)
    assert store.run(log, "three", S).count() == 0


def test_a_table_of_requests_equals_single_ones(spark, events, tmp_path):
    now = S.as_of_ms
    rows = [dict(event_id=f"e{i}", tenant_id="t", campaign_id=f"c{i % 2}", event_type="CLICK", cost=0.0, seq=i,
                 event_timestamp_ms=now - (i * i * 37_777) % (40 * 24 * HOUR_MS)) for i in range(400)]
    tables = stored.Tables(spark, str(tmp_path))
    tables.add(events(rows), "all")
    stores = stored.StoredStores(tables, S)

    def iso(ms):
        from datetime import UTC, datetime

        return datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    asked = []
    for n, (age, length, grain) in enumerate(
        [(20, 10, "hour"), (60, 30, "minute"), (60.3, 0.01, "minute"), (200, 100, "day"), (800, 50, "hour"), (1000, 30, "day"), (30, 25, "day")]
    ):
        start = now - int(age * HOUR_MS) + 1234
        asked.append((n, "t", f"c{n % 2}", "CLICK", start, start + int(length * HOUR_MS), grain))
    asked.append((99, "t", "none", "CLICK", now - HOUR_MS, now, "hour"))
    table = spark.createDataFrame(asked, "request long, tenant_id string, campaign_id string, metric string, from_ms long, to_ms long, grain string")
    got = [(r.request, r.bucket_ms, r.value) for r in stored.series_table(stores, table, S).collect()]
    assert got == sorted(got)  # in the order of the buckets
    want = []
    for n, t, c, m, a, b, g in asked:
        one = serving.tiered_series(stores, serving.Request(t, c, m, iso(a), iso(b), g), S).collect()
        assert [r.bucket_ms for r in one] == sorted(r.bucket_ms for r in one)
        want += [(n, r.bucket_ms, r.value) for r in one]
    assert got == sorted(want)


TEXT = st.text(max_size=6)
RECORD = st.fixed_dictionaries(
    {"eventId": TEXT, "tenantId": TEXT, "userId": st.none() | TEXT, "sessionId": st.none() | TEXT, "campaignId": st.none() | TEXT,
     "eventType": TEXT, "eventTimestampMs": st.integers(-(2**63), 2**63 - 1), "cost": st.floats(allow_nan=False),
     "customTags": st.dictionaries(TEXT, TEXT, max_size=3)})
FRAME = b"\0\0\0\0\7"


@settings(max_examples=150, deadline=None)
@given(st.lists(RECORD, max_size=6), st.data())
def test_avro_records_round_trip_and_broken_ones_are_found(records, data):
    values = [avro_wire.encoded(r, FRAME) for r in records]
    got = avro_wire.decoded(values)
    assert got["readable"] == [True] * len(records)
    for i, r in enumerate(records):
        assert {f.name: got[f.name][i] for f in WIRE_SCHEMA.fields} == r
    if values:  # one broken record changes no other
        i = data.draw(st.integers(0, len(values) - 1))
        cut = data.draw(st.integers(0, len(values[i]) - 1))
        broken = avro_wire.decoded([v[:cut] if k == i else v for k, v in enumerate(values)])
        assert broken["readable"] == [k != i for k in range(len(values))]
        longer = avro_wire.decoded([v + b"\0" if k == i else v for k, v in enumerate(values)])
        assert longer["readable"] == [k != i for k in range(len(values))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=5))
def test_any_bytes_are_read_without_a_crash(values):
    avro_wire.decoded([FRAME + v for v in values] + values + [None, b""])


def test_blocks_of_a_map_and_bad_text():
    head = FRAME + b"\2a\2b\0\0\0\2c\2" + b"\0" * 8
    sized = head + b"\3\x08\2k\2v\4\2m\2w\2n\2x\0"  # a block of -2 with its size... then a block of 2
    one = avro_wire.decoded([head + b"\1\x08\2k\2v\2\2m\2w\0", head[:6] + b"\xff" + head[7:] + b"\0", head + b"\2\2k\2v\0"])
    assert one["readable"] == [True, False, True]
    assert one["customTags"][0] == {"k": "v", "m": "w"} and one["customTags"][2] == {"k": "v"}
    assert avro_wire.decoded([sized])["readable"] == [False]


def test_avro_records_of_a_table(events):
    df = events([dict(event_id="e1", tenant_id="t", event_type="CLICK", event_timestamp_ms=5, cost=0.5, custom_tags={"a": "b"}),
                 dict(event_id="e2", tenant_id="t", user_id="ü", event_type="X", event_timestamp_ms=-6, cost=0.0)])
    records = kafka.encode_avro(df, F.lit("k"), 7)
    noise = records.limit(1).withColumn("value", F.lit(b"\1oops"))
    empty = records.limit(1).withColumn("value", F.lit(b""))
    good, bad = kafka.decode_avro(records.unionByName(noise).unionByName(empty))
    rows = {r.event_id: r for r in good.collect()}
    assert rows["e1"].custom_tags == {"a": "b"} and rows["e2"].custom_tags is None and rows["e2"].user_id == "ü"
    assert rows["e2"].event_timestamp_ms == -6 and rows["e1"].session_id is None
    assert bad.count() == 1 and set(WIRE_FIELDS.values()) <= set(good.columns)
