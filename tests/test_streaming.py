"""Streams over several files give the rows of the batch plans, also across a restart."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.model import EVENT_COLUMNS, EVENT_SCHEMA
from admeter.operators import aggregates as A
from admeter.operators import attribution as batch_attribution
from admeter.operators import dedup as batch_dedup
from admeter.plans import ingest
from admeter.session import state_partitions
from admeter.sources import event_table, kafka, lake
from admeter.sources.event_table import arrival_stream, canonical
from admeter.sources.shared import shared_folder
from admeter.streaming import clock, counters, job, tables
from admeter.streaming.attribution import conversions
from admeter.streaming.dedup import unique, within_watermark
from admeter.streaming.progress import ProgressLog, counted, watermark_lag_ms

SF_DIR = "/root/testdata/sf0.001"
S = Settings()
FILES = 4


@pytest.fixture(scope="module")
def batch(spark):
    return canonical(spark, SF_DIR).select(*EVENT_COLUMNS).cache()


@pytest.fixture
def arrive(batch, tmp_path):
    """Put the n-th part of the events, in time order, into the source folder."""

    def put(n):
        part = batch.where(F.floor(F.col("seq") * FILES / 1000) == n).coalesce(1)
        part.orderBy("seq").write.mode("append").parquet(str(tmp_path / "raw"))
        time.sleep(1.1)  # files are taken in the order of their time stamps

    return put


@pytest.fixture
def raw(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    return lambda: spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "raw")
    )


def rows(df):
    flat = [c for c in EVENT_COLUMNS if c != "custom_tags"]
    tags = F.to_json("custom_tags").alias("tags")
    return sorted((tuple(r) for r in df.select(*flat, tags).collect()), key=repr)


@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    with state_partitions(spark, 2):
        yield


def test_job_equals_batch_across_a_restart(spark, batch, raw, arrive, tmp_path):
    out = job.Folders(str(tmp_path / "out"))
    arrive(0)
    arrive(1)
    job.run_available(raw(), out, S)
    arrive(2)
    arrive(3)
    progress = job.run_available(raw(), out, S)
    state = [s for p in progress["unique"] for s in p.stateOperators]
    assert state and all(s.numRowsDroppedByWatermark == 0 for s in state)
    job.run_available(raw(), out, S, ends=True)
    want = ingest.enriched(batch, S)
    assert rows(job.enriched(spark, out)) == rows(want)
    dead = sorted((r.seq, r.dlq_reason, r.user_id) for r in job.dead_letters(spark, out).collect())
    assert dead == sorted((r.seq, r.dlq_reason, r.user_id) for r in ingest.rejected(batch).collect())
    assert lake.whole(spark, out.lake).count() == want.count()
    sinks = [f"{out.counters}/{name}" for name in ("unique", "conversions")]
    got = sorted(map(tuple, counters.hot_counters(spark, sinks, S).collect()))
    assert got == sorted(map(tuple, A.hot_counters(want, S).collect()))
    assert job.late_rows(spark, out).count() == 0


def run_closed(spark, stream, operator, folder, delay_ms=S.stream_lateness_ms):
    """Rows of a stateful operator over a stream that ends, and the progress of its batches."""
    made = operator(clock.timed(clock.closable(stream, f"{folder}/closing"), delay_ms), S)
    progress = []
    for last in (False, True):
        if last:
            clock.close(spark, f"{folder}/closing")
        q = (made.writeStream.format("parquet").option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
        q.awaitTermination()
        progress += q.recentProgress
    plan = q._jsq.lastProgress() and made._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan
    return spark.read.schema(made.schema).parquet(f"{folder}/rows"), progress


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_unique_equals_the_batch_rule(spark, batch, tmp_path, parts):
    stream = ingest.valid(arrival_stream(spark, SF_DIR, parts)).select(*EVENT_COLUMNS)
    got, progress = run_closed(spark, stream, unique, str(tmp_path))
    assert rows(got) == rows(ingest.kept(batch, S))
    assert max(s.numRowsTotal for p in progress for s in p.stateOperators) > 0
    assert sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators) == 0


def test_open_ids_lie_spread_in_the_state(batch):
    """Ids count up; stored in their order, deleted ones would be one run that every look-up walks."""
    plan = unique(clock.timed(batch, 0), S)._jdf.queryExecution().analyzed().toString()
    grouped = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "Aggregate [xxhash64(event_id" in grouped


@pytest.mark.parametrize("rows", [1000, 3])
def test_arrivals_have_files_for_all_cores_and_as_many_a_trigger(spark, tmp_path, rows):
    given = spark.read.parquet(f"{SF_DIR}/events.parquet").where(f"event_id < {rows}").coalesce(1)
    given.write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = arrival_stream(spark, str(tmp_path), 2)

    def look(df, n):
        at = df.agg(F.min("arrival_ms"), F.max("arrival_ms"), F.count("*")).first()
        seen.append(at)

    once = stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "c"))
    once.trigger(availableNow=True).start().awaitTermination()
    folder = max(Path(shared_folder(spark)).glob("arrivals-*"), key=lambda p: p.stat().st_mtime_ns)
    assert len(list(folder.glob("*.parquet"))) == 2 * spark.sparkContext.defaultParallelism
    assert len(seen) == 2 and seen[0][1] < seen[1][0] and sum(n for *_, n in seen) == rows


@pytest.mark.parametrize("rows", [1000, 0])
def test_arrivals_make_each_row_once_however_many_ranges(spark, tmp_path, monkeypatch, rows):
    given = spark.read.parquet(f"{SF_DIR}/events.parquet").where(f"event_id < {rows}").coalesce(1)
    given.write.parquet(str(tmp_path / "events.parquet"))
    made = spark.sparkContext.accumulator(0)

    def count(seq):
        made.add(1)
        return seq

    counted_seq = F.udf(count, "bigint").asNondeterministic()
    monkeypatch.setattr(event_table, "canonical", lambda *a: canonical(*a).withColumn("seq", counted_seq("seq")))
    stream = arrival_stream(spark, str(tmp_path), 8)
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "x"))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert made.value == rows
    assert spark.read.schema(EVENT_SCHEMA).parquet(str(tmp_path / "x")).count() == rows


def test_long_chains_of_copies(spark, raw, events, tmp_path):
    """An id redelivered every 40 minutes over a day, one beyond the TTL, ties; in three micro-batches."""
    minute = 60_000
    sent = [dict(event_id="a", event_timestamp_ms=n * 40 * minute, seq=n) for n in range(36)]
    sent += [dict(event_id="b", event_timestamp_ms=t, seq=100 + n) for n, t in enumerate((0, 60 * minute, 60 * minute + 1, 121 * minute))]
    sent += [dict(event_id="c", event_timestamp_ms=5, seq=s) for s in (203, 201, 202)]
    sent.sort(key=lambda r: r["event_timestamp_ms"])
    for n in range(3):
        events(sent[n * 15 : n * 15 + 15]).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
        time.sleep(1.1)
    got, _ = run_closed(spark, raw(), unique, str(tmp_path / "x"))
    want = batch_dedup.unique(events(sent), S, None)
    assert rows(got.drop("seq").withColumn("seq", F.col("event_timestamp_ms"))) == rows(
        want.drop("seq").withColumn("seq", F.col("event_timestamp_ms")))
    assert sorted((r.event_id, r.seq) for r in got.collect()) == sorted((r.event_id, r.seq) for r in want.collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_attribution_equals_the_batch_rule(spark, batch, tmp_path, parts):
    stream = ingest.valid(arrival_stream(spark, SF_DIR, parts)).select(*EVENT_COLUMNS)
    got, progress = run_closed(spark, stream, conversions, str(tmp_path))
    assert rows(got) == rows(batch_attribution.conversions(ingest.valid(batch), S))
    assert sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators) == 0


def test_a_hot_session(spark, raw, events, tmp_path):
    """Six thousand clicks and carts of one session in two hours: the join holds minutes, not events."""
    kinds = ["CLICK", "ADD_TO_CART", "ADD_TO_CART"]
    sent = [
        dict(event_id=f"e{n}", tenant_id="t", session_id="s", campaign_id="c", cost=1.0, event_type=kinds[n * 7 % 3],
             event_timestamp_ms=n * 1200, seq=n) for n in range(6000)]
    for n in range(2):
        events(sent[n * 3000 : n * 3000 + 3000]).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
        time.sleep(1.1)
    got, progress = run_closed(spark, raw(), conversions, str(tmp_path / "x"))
    assert rows(got) == rows(batch_attribution.conversions(events(sent), S))
    joined = [s.numRowsTotal for p in progress for s in p.stateOperators if s.operatorName == "symmetricHashJoin"]
    assert 0 < max(joined) <= 2 * 120


def test_many_days_in_one_micro_batch(spark, raw, events, tmp_path):
    """A session meets itself a day at a time, and minutes without a cart go no further than the join."""
    hour = 3_600_000
    gaps = [(n * 7919 % 13) * 2 * hour + n % 5 * 60_000 for n in range(60)]
    at = [sum(gaps[: n + 1]) for n in range(60)]
    kinds = ["CLICK", "CLICK", "CLICK", "ADD_TO_CART"]
    sent = [
        dict(event_id=f"e{n}", tenant_id="t", session_id="s", campaign_id="c", cost=1.0, event_type=kinds[n % 4],
             event_timestamp_ms=t, seq=n) for n, t in enumerate(at)]
    events(sent).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    got, progress = run_closed(spark, raw(), conversions, str(tmp_path / "x"))
    assert rows(got) == rows(batch_attribution.conversions(events(sent), S)) and got.count() > 5
    last = [p.stateOperators[0] for p in progress if p.stateOperators]
    assert 0 < sum(s.numRowsUpdated for s in last) <= 15
    plan = conversions(clock.timed(events(sent), 0), S)._jdf.queryExecution().analyzed().toString()
    assert "(span#" in next(line for line in plan.splitlines() if "Join LeftOuter" in line)


def test_a_stream_that_ends_is_started_once(spark, batch, raw, arrive, tmp_path):
    arrive(0)
    progress = job.run_available(raw(), job.Folders(str(tmp_path / "out")), S, ends=True)
    for name in ("unique", "conversions"):
        assert len({p.runId for p in progress[name]}) == 1
        assert max(s.numRowsTotal for p in progress[name] for s in p.stateOperators) > 1
        assert [s.numRowsTotal for s in progress[name][-1].stateOperators if s.operatorName != "symmetricHashJoin"][-1] == 1


def test_a_click_a_day_before_and_out_of_reach(spark, raw, events, tmp_path):
    day = S.attribution_window_ms
    base = dict(tenant_id="t", campaign_id="c", cost=1.0)
    sent = []
    for k, gap in enumerate((day, day + 1, day + 70_000, 0, 59_999, 60_000)):
        sent += [dict(base, session_id=f"s{k}", event_id=f"k{k}", event_type="CLICK", event_timestamp_ms=30_000, seq=2 * k),
                 dict(base, session_id=f"s{k}", event_id=f"a{k}", event_type="ADD_TO_CART", event_timestamp_ms=30_000 + gap, seq=2 * k + 1)]
    sent.sort(key=lambda r: r["event_timestamp_ms"])
    events(sent).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    got, _ = run_closed(spark, raw(), conversions, str(tmp_path / "x"))
    assert sorted(r.event_id for r in got.collect()) == ["a0_att", "a3_att", "a4_att", "a5_att"]


def test_a_batch_that_runs_again_changes_nothing(spark, batch, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.write_batch(batch.limit(10), path, 0)
        counters.add_deltas(batch, str(tmp_path / "c"), 3)
        lake.append(ingest.valid(batch), str(tmp_path / "lake"), "batch-0")
    assert tables.read_batches(spark, path, EVENT_SCHEMA).count() == 10
    hours = counters.hourly_counts(spark, [str(tmp_path / "c")])
    assert hours.agg(F.sum("cnt")).first()[0] == A.countable(batch).count()
    assert lake.whole(spark, str(tmp_path / "lake")).count() == ingest.valid(batch).count()


def test_late_rows_merge_into_the_lake_of_a_stream(spark, batch, tmp_path):
    path = str(tmp_path / "lake")
    valid = ingest.valid(batch).select(*EVENT_COLUMNS)
    for n in range(2):
        lake.append(valid.where(F.col("seq") % 2 == n), path, f"batch-{n}")
    first = valid.where("event_id = 'evt_0' OR seq < 5")
    late_rows = first.withColumn("event_id", F.concat("event_id", F.lit("x")))
    lake.upsert_late(spark, path, late_rows, S)
    got = lake.whole(spark, path)
    assert got.where("event_id LIKE '%x'").count() == late_rows.count()
    assert got.select("tenant_id", "event_id").distinct().count() == (
        valid.unionByName(late_rows).select("tenant_id", "event_id").distinct().count()
    )
    once = got.count()
    lake.upsert_late(spark, path, late_rows, S)
    assert lake.whole(spark, path).count() == once
    lake.drop_partitions(spark, path, lambda v: v["tenant_id"] == "tenant_1")
    assert lake.scan(spark, path, "tenant_1").count() == 0 < lake.scan(spark, path, "tenant_2").count()


def test_an_id_of_two_tenants_stays_with_both(spark, events, tmp_path):
    path = str(tmp_path / "lake")
    one = dict(event_id="e", event_timestamp_ms=5)
    lake.append(events([dict(one, tenant_id="a"), dict(event_id="f", tenant_id="b", event_timestamp_ms=6)]), path)
    lake.upsert_late(spark, path, events([dict(one, tenant_id="a"), dict(one, tenant_id="b")]), S)
    assert sorted((r.tenant_id, r.event_id) for r in lake.whole(spark, path).collect()) == [
        ("a", "e"), ("b", "e"), ("b", "f")]


def test_a_row_dated_far_ahead_changes_no_other_id(spark, raw, events, tmp_path):
    """A copy in the next micro-batch is still a duplicate, a cart still finds its click; the row goes aside."""
    base = dict(tenant_id="t", user_id="u", session_id="s", campaign_id="c", arrival_ms=1_000_000, cost=0.0)
    click = dict(base, event_id="a", event_type="CLICK", event_timestamp_ms=1_000_000)
    ahead = dict(base, event_id="z", event_type="IMPRESSION", session_id="far", event_timestamp_ms=10 * 86_400_000)
    cart = dict(base, event_id="b", event_type="ADD_TO_CART", event_timestamp_ms=1_002_000)
    for part in ([click, ahead], [dict(click, event_timestamp_ms=1_001_000, seq=5), dict(cart, seq=6)]):
        events(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
        time.sleep(1.1)
    out = job.Folders(str(tmp_path / "out"))
    job.run_available(raw(), out, S, ends=True)
    assert sorted(r.event_id for r in job.enriched(spark, out).collect()) == ["a", "b", "b_att"]
    assert [r.event_id for r in job.late_rows(spark, out).collect()] == ["z"]


def test_unreadable_and_late_records_of_the_job(spark, events, tmp_path):
    """Records decode inside the job; unreadable ones and late events get tables of their own."""
    base = dict(tenant_id="t", user_id="u", session_id="s", campaign_id="c", event_type="CLICK", cost=0.0)
    at = (2_900_000, 2_800_000, 100_000)
    sent = events([dict(base, event_id=f"e{n}", event_timestamp_ms=t) for n, t in enumerate(at)])
    records = kafka.raw_records(sent).withColumns({
        "timestamp": F.timestamp_millis(F.lit(2_900_000)), "partition": F.lit(0),
        "offset": F.regexp_extract("value", r'"e(\d)"', 1).cast("bigint")})
    noise = records.limit(1).withColumn("value", F.lit("{oops"))
    path = str(tmp_path / "records")
    records.unionByName(noise).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(records.schema).parquet(path)
    out = job.Folders(str(tmp_path / "out"))
    job.run_available(stream, out, S, ends=True, decode=kafka.decode_json)
    assert sorted(r.event_id for r in job.enriched(spark, out).collect()) == ["e0", "e1"]
    assert [r.payload for r in spark.read.parquet(out.unreadable).collect()] == ["{oops"]
    assert [r.event_id for r in job.late_rows(spark, out).collect()] == ["e2"]


def test_built_in_dedup_drops_copies_across_batches(spark, raw, events, tmp_path):
    def arrive(*rows):
        events([dict(event_id=i, event_timestamp_ms=t) for i, t in rows]).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "raw"))
        time.sleep(1.1)

    arrive(("a", 0), ("a", 10))
    arrive(("a", 20), ("b", 30))
    q = (within_watermark(raw(), S).writeStream.format("parquet").option("path", str(tmp_path / "kept"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert sorted(r.event_id for r in kept.collect()) == ["a", "b"]


def test_running_counts_go_on_after_a_restart(spark, raw, arrive, batch, tmp_path):
    where = str(tmp_path / "counts"), str(tmp_path / "checkpoint")
    for n in range(FILES):
        arrive(n)
        if n in (1, 3):
            counters.count_stream(ingest.valid(raw()), *where).awaitTermination()
    got = sorted(map(tuple, counters.current_counts(spark, where[0]).collect()))
    want = A.counts(ingest.valid(batch).dropna(subset=["campaign_id"]))
    assert got == sorted(map(tuple, want.collect()))


def test_progress_figures(spark, raw, arrive, tmp_path):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        arrive(0)
        seen = counted(raw(), "raw_rows", clicks=F.col("event_type") == "CLICK", all=F.lit(True))
        kept = within_watermark(ingest.valid(seen), S)
        q = (
            kept.writeStream.format("parquet")
            .option("path", str(tmp_path / "kept"))
            .option("checkpointLocation", str(tmp_path / "cp"))
            .queryName("kept")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
        deadline = time.time() + 20
        while not any(e["rows"] for e in log.entries) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    entry = next(e for e in log.entries if e["rows"])
    assert entry["query"] == "kept" and entry["rows"] == 250
    assert entry["observed"]["raw_rows"]["all"] == 250
    assert entry["state_rows"] > 0


def test_watermark_lag():
    times = {"max": "2024-01-01T00:10:00.000Z", "watermark": "2024-01-01T00:05:00.000Z"}
    assert watermark_lag_ms(times) == 300_000
    assert watermark_lag_ms({}) is None
