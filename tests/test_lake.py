import hashlib
import os

import pytest
from pyspark.sql import functions as F

from admeter.config import DAY_MS, Settings
from admeter.operators import dead_letter
from admeter.sources import kafka, lake, parts


def row(i, tenant, day, **more):
    return dict(event_id=f"e{i}", tenant_id=tenant, event_timestamp_ms=day * DAY_MS + i, seq=i, **more)


def folders(spark, path):
    return sorted({e["folder"] for e in lake.table(spark, path).live()})


def test_append_scan_and_pruning(events, spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.append(events([row(i, f"t{i % 2}", i % 5, custom_tags={"a": "b"}, user_id="u") for i in range(100)]), path)
    lake.append(events([row(200, "t0", 1)]), path)
    assert lake.whole(spark, path).count() == 101
    assert {r.user_id for r in lake.whole(spark, path).collect()} == {None, "anon_" + hashlib.sha256(b"u").hexdigest()[:12]}
    rows = lake.scan(spark, path, "t0", DAY_MS, 2 * DAY_MS)
    # days 1 and 2 of t0: the upper bound is the first millisecond of day 2
    assert rows.where(F.col("event_date") == "1970-01-02").count() == rows.count() == 11
    assert all("tenant_id=t0" in f and ("1970-01-02" in f or "1970-01-03" in f) for f in rows.inputFiles())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "event_date" in plan.split("PushedFilters")[0]
    assert "GreaterThanOrEqual(event_timestamp_ms" in plan


def test_erase_purge_and_vacuum_open_no_data(events, spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.append(events([row(i, f"t{i % 2}", i % 4) for i in range(40)] + [row(50, "a/b %", 2), row(51, None, 2)]), path)
    assert lake.scan(spark, path, "a/b %").count() == 1
    for base, _, names in os.walk(path):  # unreadable data would fail any job that opens it
        for name in names:
            if name.endswith(".parquet") and "tenant_id=t1" in base:
                open(f"{base}/{name}", "wb").write(b"broken")
    assert lake.erase(spark, path, "t1") == 2
    assert not [f for f in folders(spark, path) if "t1" in f]
    assert not [b for b, _, names in os.walk(path) if "tenant_id=t1" in b and any(n.endswith(".parquet") for n in names)]
    settings = Settings(as_of_ms=3 * DAY_MS, retention_ms={"x": DAY_MS})
    assert lake.purge(spark, path, "x", settings) == 1  # day 0 goes, day 2 stays
    assert lake.whole(spark, path).select("event_date").distinct().count() == 1


def test_upsert_replaces_only_touched_partitions(events, spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.append(events([row(i, "t", i % 3) for i in range(9)]), path)
    before = {(e["part"], e["folder"]) for e in lake.table(spark, path).live()}
    late = events([row(1, "t", 1), row(50, "t", 1, custom_tags={"k": "v"})])  # one known, one new
    lake.upsert_late(spark, path, late, Settings(broadcast_rows=0))
    lake.upsert_late(spark, path, late, Settings())  # again: no change
    got = lake.whole(spark, path)
    assert got.count() == 10 and got.where("event_id = 'e50'").first().custom_tags == {"k": "v"}
    after = {(e["part"], e["folder"]) for e in lake.table(spark, path).live()}
    assert {f for _, f in before - after} == {f for _, f in after - before} == {"tenant_id=t/event_date=1970-01-02"}


def test_a_reader_between_write_and_commit_sees_each_event_once(events, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    lake.append(events([row(i, "t", 1) for i in range(9)]), path)
    seen = []
    commit = parts.Parts.commit

    def watched(self, change):
        seen.append(lake.whole(spark, path).count())  # the merged part is written but not listed
        commit(self, change)
        seen.append(lake.whole(spark, path).count())

    reader = lake.whole(spark, path)  # planned before the merge: the old files stay until a vacuum
    monkeypatch.setattr(parts.Parts, "commit", watched)
    lake.upsert_late(spark, path, events([row(1, "t", 1), row(50, "t", 1)]), Settings())
    assert seen == [9, 10] and reader.count() == 9


def test_writers_that_meet(events, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    one, two = lake.table(spark, path), lake.table(spark, path)
    rows = lake.laid_out(events([row(1, "t", 1)]))
    real, calls = parts.Parts.live, []

    def slow(self, version=None):
        found = real(self, version)
        if self is one and not calls:
            calls.append(1)
            two.add(rows, "b")  # another writer is first
        return found

    monkeypatch.setattr(parts.Parts, "live", slow)
    one.add(rows, "a")
    assert sorted(e["tag"] for e in real(one)) == ["a", "b"]
    stale = real(one)
    one.drop(lambda v: True)
    with pytest.raises(RuntimeError):
        one.replace(stale, rows, "c")


def test_compaction(events, spark, tmp_path):
    path = str(tmp_path / "lake")
    for n in range(4):
        lake.append(events([row(10 * n + i, f"t{i % 2}", 1) for i in range(5 if n else 4)]), path, f"batch-{n}")
    lake.append(events([row(31, "t1", 1)]), path, "batch-3")  # the batch runs again
    want = sorted(r.event_id for r in lake.whole(spark, path).collect())
    assert lake.compact(spark, path, most=3) == 1 and lake.compact(spark, path, most=3) == 0
    assert sorted(r.event_id for r in lake.whole(spark, path).collect()) == want
    assert len([f for f in lake.scan(spark, path, "t1").inputFiles()]) == 1
    table = lake.table(spark, path)
    for _ in range(parts.VERSIONS):
        table.commit(lambda old: old)
    assert table.vacuum(older_than_ms=3_600_000) == 3  # those in parts that are still live
    assert sorted(r.event_id for r in lake.whole(spark, path).collect()) == want


def test_json_wire_format(events, spark):
    rows = [dict(event_id="e1", tenant_id="t", session_id="s", event_type="CLICK", event_timestamp_ms=5, cost=0.5),
            dict(event_id="e2", tenant_id="t", event_type="CLICK", event_timestamp_ms=6, cost=0.0,
                 custom_tags={"a": "b"})]
    records = kafka.raw_records(events(rows))
    assert [r.key for r in records.orderBy("value").collect()] == ["t:s", "t:null"]
    assert '"customTags":{}' in records.where("key = 't:s'").first().value
    noise = spark.createDataFrame([("k", ""), ("k", None), ("k", "{oops"), ("k", "[1]")], "key string, value string")
    good, bad = kafka.decode_json(records.unionByName(noise))
    got = {r.event_id: r for r in good.collect()}
    assert set(got) == {"e1", "e2"} and got["e1"].custom_tags is None and got["e2"].custom_tags == {"a": "b"}
    assert got["e1"].cost == 0.5 and got["e2"].session_id is None
    assert sorted(r.payload for r in bad.collect()) == ["[1]", "{oops"]


def test_arrival_order_of_records(spark, events):
    records = kafka.raw_records(events([dict(event_id="e", tenant_id="t", event_type="CLICK", event_timestamp_ms=1)]))
    rows = records.select(
        "value", F.timestamp_millis(F.lit(7)).alias("timestamp"), F.lit(3).cast("bigint").alias("offset"),
        F.explode(F.array(F.lit(0), F.lit(5))).alias("partition"))
    good, _ = kafka.decode_json(rows)
    assert sorted((r.arrival_ms, r.seq) for r in good.collect()) == [(7, 3 * 65536), (7, 3 * 65536 + 5)]


def test_dead_letter_records(events):
    df = events([dict(event_id="e", event_type="X")]).withColumn("dlq_reason", F.lit("bad"))
    r = kafka.dead_letter_records(df).first()
    assert r.key == "unknown" and r.headers[0].key == "dlq-reason" and bytes(r.headers[0].value) == b"bad"


def test_replay(events):
    rows = [dict(event_id=f"e{i}", user_id=u, session_id="s", event_type="CLICK", event_timestamp_ms=i)
            for i, u in enumerate(["u", None, "u", "u"])]
    keys = F.when(F.col("seq") < 3, F.lit("Tenant_A")).otherwise(F.lit("other"))
    log = events(rows).withColumns({
        "key": keys, "dlq_reason": F.when(F.col("seq") == 2, F.lit("Other: x")).otherwise(F.lit("Missing: x")),
        "partition": F.lit(0), "offset": F.col("seq")})
    s = Settings()
    assert dead_letter.replay_size(0, s) is None and dead_letter.replay_size(10**6, s) == 10**6
    first = dead_letter.polled(log, s, requested=3)
    rest = dead_letter.polled(log, s, after=dead_letter.next_offsets(first))
    assert [sorted(r.offset for r in x.collect()) for x in (first, rest)] == [[0, 1, 2], [3]]
    polled = dead_letter.polled(log, s, "tenant_a", "Missing")
    assert sorted(r.event_id for r in dead_letter.replay(polled).collect()) == ["e0", "e1"]
    assert dead_letter.replay_summary(polled).first().asDict() == dict(
        replayed=2, skipped=2, rejected_again=1, total=4)
    capped = dead_letter.replay_summary(dead_letter.polled(log, s, "other", None, 3)).first()
    assert (capped.replayed, capped.skipped, capped.total) == (0, 3, 3)  # the cap counts records read
    assert dead_letter.polled(log, s, None, "missing").where("replayed").count() == 0  # case counts
    total = dead_letter.stats(log).where("partition IS NULL").first()
    assert total.lag == 4
    empty = dead_letter.stats(log.where("false")).collect()
    assert len(empty) == 1 and empty[0].lag == 0
