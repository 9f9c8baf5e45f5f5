"""Named queries over the given tables: one callable ``(spark, sf_dir) -> DataFrame`` each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.config import DAY_MS, HOUR_MS, Settings
from admeter.functions import events as E
from admeter.functions import privacy
from admeter.model import CONVERSION, COUNT_KEYS, EVENT_COLUMNS, WIRE_FIELDS
from admeter.operators import aggregates as A
from admeter.operators import alerts, attribution, dead_letter, dedup, late, monitoring, quantiles
from admeter.operators import rate_limit, reconcile, replay, run_store
from admeter.operators import timeseries as S
from admeter.plans import ingest, serving, stored
from admeter.session import prepare, state_partitions, uncounted_state
from admeter.sources import kafka, lake
from admeter.sources.event_table import (
    arrival_stream,
    canonical,
    dead_letters,
    read_table,
    request_log,
)
from admeter.sources.shared import file_state, keep, new_path
from admeter.streaming import attribution as stream_attribution
from admeter.streaming import clock, counters, job
from admeter.streaming import dedup as stream_dedup

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
SETTINGS = replace(
    Settings(), warm_window_ms=10 * DAY_MS, quota_default=1, quota_window_s=600
)
QUOTAS = {"tenant_0": 3}
GRANTS = [
    ("tenant_0", "camp_0"),
    ("tenant_0", "camp_1"),
    ("tenant_0", "camp_2"),
    ("tenant_1", "camp_3"),
]
AS_OF = SETTINGS.as_of_ms
WARM_FROM = AS_OF - 9 * DAY_MS
TENANT, CAMPAIGN, METRIC = "tenant_1", "camp_4", "CLICK"
FLAT = [c for c in EVENT_COLUMNS if c != "custom_tags"]
CONVERSION_COLUMNS = [
    "event_id", "tenant_id", "user_id", "session_id", "campaign_id", "event_type",
    "event_timestamp_ms", "cost", "seq",
]


def ms():
    return F.col("event_timestamp_ms")


REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def stream_query(f: Query) -> Query:
    """A query that runs streams; their state has one partition per core, and nobody asks for its size."""

    @wraps(f)
    def run(spark, sf):
        with state_partitions(prepare(spark)), uncounted_state(spark):
            return f(spark, sf)

    REGISTRY[f.__name__] = run
    return run


# ---- inputs shared by the queries -------------------------------------------------------


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.valid(canonical(spark, sf))


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.rejected(canonical(spark, sf))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.kept(canonical(spark, sf), SETTINGS)


def _converted(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.converted(canonical(spark, sf), SETTINGS)


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.enriched(canonical(spark, sf), SETTINGS)


def _warm(enriched: DataFrame) -> DataFrame:
    """For reconciliation: a warm table that has lost one event in 200."""
    return enriched.where(F.col("seq") % 200 != 0)


def _hot(enriched: DataFrame) -> DataFrame:
    """For reconciliation: hot counters that have missed one event in 50."""
    return enriched.where(F.col("seq") % 50 != 0)


def _build(spark: SparkSession, sf: str, deltas: int = 4) -> stored.Tables:
    """Stored tables of the enriched events, taken in by ranges of time."""
    tables = stored.Tables(spark, new_path(spark, "stored"))
    events = keep(_enriched(spark, sf), "stored-events")
    shares = [i / deltas for i in range(1, deltas)]
    cuts = events.agg(F.percentile_approx("event_timestamp_ms", shares, 10_000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        rows = events if low is None else events.where(ms() > low)
        tables.add(rows if high is None else rows.where(ms() <= high), f"batch-{n}")
    return tables


_STORED: dict[tuple, stored.Tables] = {}


def _tables(spark: SparkSession, sf: str) -> stored.Tables:
    """The stored tables of a folder, built once per application and state of its files."""
    files = read_table(spark, sf, "events").inputFiles()
    key = (spark.sparkContext.applicationId, *sorted((f, file_state(spark, f)) for f in files))
    if key not in _STORED:
        _STORED.clear()
        _STORED[key] = _build(spark, sf)
    return _STORED[key]


def _stores(spark: SparkSession, sf: str) -> stored.StoredStores:
    return stored.StoredStores(_tables(spark, sf), SETTINGS)


def _dlq(spark: SparkSession, sf: str) -> DataFrame:
    return dead_letters(_rejected(spark, sf))


# ---- projections and checks -------------------------------------------------------------


@query
def normalize_event_type(spark, sf):
    raw = F.col("event_type")
    return canonical(spark, sf).select(
        "seq", raw.alias("raw_type"), E.normalize_type(raw).alias("event_type")
    )


@query
def validate_events(spark, sf):
    return ingest.checked(canonical(spark, sf)).select("seq", "event_id", "dlq_reason")


@query
def field_errors(spark, sf):
    errors = canonical(spark, sf).select("seq", E.field_errors().alias("e"))
    return errors.where(F.size("e") > 0).select(
        "seq", F.concat_ws("; ", "e").alias("field_errors"), F.size("e").alias("error_count")
    )


@query
def valid_events(spark, sf):
    return lake.with_date(_valid(spark, sf)).select(
        *FLAT, F.col("event_date").cast("string").alias("event_date")
    )


@query
def dlq_events(spark, sf):
    return _rejected(spark, sf).select("key", "dlq_reason", *FLAT)


@query
def dlq_redacted(spark, sf):
    return privacy.redact(canonical(spark, sf)).select(
        "seq", "user_id", F.col("custom_tags").isNull().alias("tags_dropped")
    )


@query
def mask_pii(spark, sf):
    text = privacy.mask(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", text.alias("masked_text"))


@query
def pseudonymize_users(spark, sf):
    return canonical(spark, sf).select(
        "seq", "user_id", privacy.pseudonymize(F.col("user_id")).alias("pseudonym")
    )


@query
def event_keys(spark, sf):
    return canonical(spark, sf).select(
        "seq",
        E.raw_key().alias("raw_key"),
        E.enriched_key().alias("enriched_key"),
        E.dlq_key().alias("dlq_key"),
        E.counter_key().alias("counter_key"),
        E.series_key().alias("series_key"),
    )


@query
def time_buckets(spark, sf):
    return canonical(spark, sf).select(
        "seq",
        E.hour_bucket(ms()).alias("hour_bucket_ms"),
        *[E.truncate_ms(ms(), g).alias(f"{g}_ms") for g in E.GRAIN_MS],
        E.event_date(ms()).cast("string").alias("event_date"),
        E.iso_instant(ms()).alias("instant"),
    )


@query
def request_binding(spark, sf):
    """All requests bound to tenant_2; every 10th comes without an event time."""
    requests = canonical(spark, sf)
    untimed = F.when(F.col("seq") % 10 == 0, F.lit(0)).otherwise(ms()).cast("bigint")
    bound = ingest.from_requests(
        requests.withColumn("event_timestamp_ms", untimed), "tenant_2", SETTINGS
    )
    return bound.select("seq", "tenant_id", "event_timestamp_ms")


@query
def request_windows(spark, sf):
    """Tolerant parsing of request bounds and their defaults."""
    second = ms() - F.pmod(ms(), F.lit(1000))
    from_text = F.expr("CASE seq % 5 WHEN 1 THEN '' WHEN 2 THEN 'yesterday' END")
    from_text = F.when(F.col("seq") % 5 == 0, E.iso_instant(second)).when(
        F.col("seq") % 5 == 3, E.iso_instant(ms())
    ).otherwise(from_text)
    to_text = F.when(F.col("seq") % 3 == 0, E.iso_instant(second + HOUR_MS)).otherwise(F.lit(" "))
    parsed = canonical(spark, sf).select(
        "seq",
        E.parse_instant_ms(from_text).alias("parsed_from_ms"),
        F.coalesce(E.parse_instant_ms(to_text), F.lit(AS_OF)).alias("to_ms"),
    )
    default = F.col("to_ms") - SETTINGS.default_window_ms
    return parsed.withColumn("from_ms", F.coalesce("parsed_from_ms", default))


@query
def valid_campaign_ids(spark, sf):
    names = ("campaign_id", "placement_id", "user_id")
    return canonical(spark, sf).select(
        "seq", *[E.valid_id(F.col(n)).alias(f"{n}_ok") for n in names]
    )


@query
def label_cleanup(spark, sf):
    return ingest.checked(canonical(spark, sf).withColumn("tenant_id", E.label(F.col("tenant_id")))).select(
        "seq", "tenant_id", E.abbreviate(F.col("dlq_reason")).alias("reason")
    )


@query
def abbreviate_texts(spark, sf):
    text = E.abbreviate(F.col("text")).alias("label")
    return read_table(spark, sf, "documents").select("doc_id", text)


# ---- de-duplication ---------------------------------------------------------------------


@query
def dedup_ttl(spark, sf):
    return _kept(spark, sf).select(*FLAT)


@query
def dedup_state_size(spark, sf):
    return dedup.live_keys(_kept(spark, sf), SETTINGS)


@query
def billing_exact_counts(spark, sf):
    first = dedup.first_per_id(_valid(spark, sf), COUNT_KEYS)
    return A.counts(first)


@query
def dedup_dropped_by_tenant(spark, sf):
    return dedup.dropped_by(_valid(spark, sf), _kept(spark, sf), ["tenant_id"])


# ---- attribution ------------------------------------------------------------------------


@query
def click_to_basket(spark, sf):
    return _converted(spark, sf).select(
        *CONVERSION_COLUMNS,
        attribution.duration_ms().alias("duration_ms"),
        attribution.attributed_click().alias("attributed_click_id"),
    )


@query
def enriched_events(spark, sf):
    return _enriched(spark, sf).select(
        *FLAT, E.enriched_key().alias("key"), attribution.duration_ms().alias("duration_ms")
    )


# ---- aggregates -------------------------------------------------------------------------


@query
def store_build(spark, sf):
    """Cost of taking the events in, and what the minute roll-up holds per tenant and date."""
    tables = _build(spark, sf)
    tables.compact(SETTINGS, AS_OF, most=2)
    rows = tables.rollup.read().groupBy("tenant_id", F.col("event_date").cast("string").alias("event_date"))
    return rows.agg(F.sum("cnt").alias("cnt"), F.sum("cost").cast("double").alias("sum_cost"))


@query
def campaign_count(spark, sf):
    return _stores(spark, sf).warm_count((TENANT, CAMPAIGN, METRIC))


@query
def grouped_counts(spark, sf):
    return A.grouped_counts(
        _enriched(spark, sf), AS_OF - 10 * DAY_MS, AS_OF, SETTINGS.max_campaigns_per_run
    )


@query
def hot_counters(spark, sf):
    return _stores(spark, sf).hot_counts()


@query
def hot_hourly_series(spark, sf):
    return _stores(spark, sf).hot_points()


@query
def star_cube_placement(spark, sf):
    return A.cube_placement(_enriched(spark, sf))


@query
def star_cube_geo_device(spark, sf):
    return A.cube_geo_device(_enriched(spark, sf))


@query
def cube_campaign_cost(spark, sf):
    """Count and cost of every campaign of a tenant: one level and one tenant of the stored cube."""
    rows = stored.cube_rows(
        _tables(spark, sf).placement, A.PLACEMENT_DIMS, ["tenant_id", "campaign_id"], tenant_id=TENANT
    )
    return rows.select("tenant_id", "campaign_id", "cnt", F.col("cost").cast("double").alias("sum_cost"))


@query
def cube_geo_totals(spark, sf):
    """Counts per country from the stored second cube, where the smallest level that keeps it answers."""
    return stored.cube_rows(_tables(spark, sf).geo, A.GEO_DIMS, ["geo_country"]).drop("cost")


@query
def minute_rollup(spark, sf):
    return A.minute_rollup(_enriched(spark, sf))


@query
def type_breakdown(spark, sf):
    return A.type_breakdown(_enriched(spark, sf), TENANT, CAMPAIGN, "2024-01-10", "2024-01-25")


@query
def ingest_outcomes(spark, sf):
    rows = ingest.checked(canonical(spark, sf))
    accepted = F.col("dlq_reason").isNull()
    return rows.groupBy(
        E.label(F.col("tenant_id")).alias("tenant_id"),
        F.when(accepted, "accepted").otherwise("validation_failed").alias("status"),
        F.when(accepted, F.col("normal_type")).otherwise("unknown").alias("event_type"),
        F.when(accepted, "").otherwise(E.abbreviate(F.col("dlq_reason"))).alias("reason"),
    ).agg(F.count("*").alias("cnt"))


@query
def processed_by_type(spark, sf):
    return A.counts(_kept(spark, sf), ["tenant_id", "event_type"])


@query
def attributed_by_campaign(spark, sf):
    return A.counts(_converted(spark, sf), ["tenant_id", "campaign_id"])


@query
def count_with_fallback(spark, sf):
    stores = _stores(spark, sf)
    return A.with_fallback(stores.hot_counts(), stores.warm_counts())


@query
def authorized_campaign_counts(spark, sf):
    grants = spark.createDataFrame(GRANTS, "tenant_id string, campaign_id string")
    return A.authorized(A.counts(A.countable(_enriched(spark, sf))), grants)


# ---- time series ------------------------------------------------------------------------


def _series(grain: str) -> Query:
    def run(spark, sf):
        key = (TENANT, CAMPAIGN, METRIC)
        series = _stores(spark, sf).warm_series(key, None, WARM_FROM + 1234, AS_OF - DAY_MS + 1, grain)
        return series.orderBy("bucket_ms")

    return run


for _grain in E.GRAIN_MS:
    REGISTRY[f"series_warm_{_grain}"] = _series(_grain)


@query
def series_by_placement(spark, sf):
    """The placement of a request is a real filter here."""
    key = (TENANT, CAMPAIGN, "IMPRESSION")
    return _stores(spark, sf).warm_series(key, "plc_0", WARM_FROM, AS_OF, "day").orderBy("bucket_ms")


@query
def series_cold(spark, sf):
    window = AS_OF - 25 * DAY_MS + HOUR_MS, AS_OF - 12 * DAY_MS + 5
    series = _stores(spark, sf).cold_series((TENANT, CAMPAIGN, METRIC), None, *window, "DAY")
    return series.orderBy("bucket_ms")


@query
def series_hot(spark, sf):
    series = S.hot_series(_stores(spark, sf).hot_points(), AS_OF - 2 * DAY_MS + 1, AS_OF)
    return series.orderBy(*COUNT_KEYS, "bucket_ms")


@query
def bucket_spine(spark, sf):
    """Hours and minutes of every tenant's time range; the minutes reach the bucket cap."""
    span = _valid(spark, sf).groupBy("tenant_id").agg(F.min(ms()).alias("a"), F.max(ms()).alias("b"))
    parts = [
        span.select(
            "tenant_id",
            F.lit(grain).alias("grain"),
            F.posexplode(S.spine(F.col("a"), F.col("b"), grain, SETTINGS.max_buckets)).alias(
                "position", "bucket_ms"
            ),
        )
        for grain in ("hour", "minute")
    ]
    return parts[0].unionByName(parts[1])


@query
def series_even_split(spark, sf):
    totals = A.counts(_valid(spark, sf), ["tenant_id", "event_type"])
    points = S.even_split(F.col("cnt"), F.lit(WARM_FROM + 5), F.lit(AS_OF), "hour")
    none = S.even_split(F.col("cnt"), F.lit(AS_OF + HOUR_MS), F.lit(AS_OF), "hour")
    whole = totals.select("tenant_id", "event_type", F.inline(points)).withColumn("spread", F.lit(True))
    at_end = totals.select("tenant_id", "event_type", F.inline(none)).withColumn("spread", F.lit(False))
    return whole.unionByName(at_end)


@query
def rate_limit_admission(spark, sf):
    rows = ingest.bound(canonical(spark, sf)).select("seq", "tenant_id", "event_timestamp_ms")
    return rate_limit.admission(rows, QUOTAS, SETTINGS).select(
        "seq", "tenant_id", "window_no", "position", "quota", "admitted"
    )


@query
def rate_limit_remaining(spark, sf):
    return rate_limit.remaining(ingest.bound(canonical(spark, sf)), QUOTAS, SETTINGS)


# ---- serving ----------------------------------------------------------------------------


@query
def route_requests(spark, sf):
    untimed = F.when(F.col("seq") % 7 == 0, F.lit(None)).otherwise(F.col("from_ms"))
    requests = request_log(spark, sf).withColumn("from_ms", untimed)
    return serving.route_table(requests, SETTINGS).select("seq", "from_ms", "tier")


@query
def tiered_counts(spark, sf):
    requests = request_log(spark, sf).where("tenant_id <> ''")
    answers = serving.tiered_count_table(_stores(spark, sf), requests, SETTINGS)
    return answers.withColumn("from_date", F.col("from_date").cast("string"))


@query
def tiered_count_single(spark, sf):
    """One count per tier."""
    stores = _stores(spark, sf)
    parts = []
    for age in (1, 9, 20):
        request = serving.Request(
            TENANT, CAMPAIGN, METRIC, f"2024-01-{31 - age:02d}T06:00:00Z"
        )
        tier = serving.resolve_tier(serving.instant_ms(request.from_text), SETTINGS)
        count = serving.tiered_count(stores, request, SETTINGS)
        parts.append(count.select(F.lit(tier).alias("tier"), "cnt"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def series_tiered(spark, sf):
    """One series per tier, and one that falls back to an even split."""
    stores = _stores(spark, sf)
    requests = {
        "hot": serving.Request(TENANT, CAMPAIGN, METRIC, "2024-01-30T00:00:00Z"),
        "warm": serving.Request(
            TENANT, CAMPAIGN, METRIC, "2024-01-25T00:00:00Z", "2024-01-29T12:00:00Z"
        ),
        "cold": serving.Request(
            TENANT, CAMPAIGN, METRIC, "2024-01-05T10:00:00Z", "2024-01-15T12:00:00Z", "day"
        ),
        "split": serving.Request(
            TENANT, CAMPAIGN, METRIC, "2024-02-01T00:10:00Z", "2024-02-01T06:00:00Z"
        ),
    }
    parts = [
        serving.tiered_series(stores, r, SETTINGS).select(F.lit(n).alias("request"), "bucket_ms", "value")
        for n, r in requests.items()
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query
def series_requests(spark, sf):
    """The series of every request of the log, six hours each, in one plan."""
    log = request_log(spark, sf).where("tenant_id <> ''")
    grain = F.when(F.col("seq") % 8 == 0, "minute").when(F.col("seq") % 2 == 0, "hour").otherwise("day")
    requests = log.select(
        F.col("seq").alias("request"), "tenant_id", "campaign_id", "metric", "from_ms",
        (F.col("from_ms") + 6 * HOUR_MS).alias("to_ms"), grain.alias("grain"),
    )
    return stored.series_table(_stores(spark, sf), requests, SETTINGS)


@query
def campaign_metrics(spark, sf):
    return serving.campaign_metrics(_enriched(spark, sf), WARM_FROM, AS_OF, "hour", SETTINGS)


@query
def campaign_metric_response(spark, sf):
    request = serving.Request(TENANT, CAMPAIGN, METRIC, "2024-01-24T00:00:00Z", None, "day")
    return serving.metric_response(_stores(spark, sf), request, SETTINGS, {CAMPAIGN})


@query
def hot_exists(spark, sf):
    campaigns = request_log(spark, sf).select("tenant_id", "campaign_id").distinct()
    return serving.exists_in_hot(_stores(spark, sf), campaigns)


@query
def tier_usage(spark, sf):
    log = serving.route_table(request_log(spark, sf), SETTINGS)
    return log.groupBy(E.label(F.col("tenant_id")).alias("tenant_id"), "metric", "tier").agg(
        F.count("*").alias("queries"),
        F.count_if("cache_hit").alias("hits"),
        F.count_if(~F.col("cache_hit")).alias("misses"),
    )


# ---- reconciliation ---------------------------------------------------------------------


def _recon_hourly(spark, sf):
    events = _enriched(spark, sf)
    hot = A.hot_counters(_hot(events), SETTINGS)
    return reconcile.hourly(_warm(events), hot, SETTINGS)


def _recon_daily(spark, sf):
    events = _enriched(spark, sf)
    return reconcile.daily(_warm(events), events, SETTINGS)


def _history(spark, sf):
    events = _enriched(spark, sf)
    return reconcile.history_results(_hot(events), _warm(events), events, SETTINGS)


@query
def recon_hourly(spark, sf):
    return _recon_hourly(spark, sf)


@query
def recon_hourly_bucketed(spark, sf):
    """Hourly runs of the last day, hot hours against the same warm hours."""
    rows = _history(spark, sf)
    return rows.where((F.col("window") == "hourly") & (F.col("window_start_ms") >= AS_OF - DAY_MS))


@query
def recon_patched_counters(spark, sf):
    events = _enriched(spark, sf)
    hot = A.hot_counters(_hot(events), SETTINGS)
    return reconcile.patched_counters(hot, reconcile.hourly(_warm(events), hot, SETTINGS))


@query
def recon_daily(spark, sf):
    return _recon_daily(spark, sf)


@query
def recon_summary(spark, sf):
    day = AS_OF - AS_OF % DAY_MS
    hourly = reconcile.report(
        _recon_hourly(spark, sf), "hourly", AS_OF - 2 * HOUR_MS, AS_OF, AS_OF, SETTINGS
    )
    daily = reconcile.report(
        _recon_daily(spark, sf), "daily", day - DAY_MS, day, AS_OF, SETTINGS
    )
    return hourly.unionByName(daily)


@query
def recon_reports(spark, sf):
    reports = reconcile.history_reports(_history(spark, sf), SETTINGS)
    return reconcile.newest(reconcile.retained(reports, SETTINGS), 100, SETTINGS)


@query
def recon_status(spark, sf):
    return reconcile.status(reconcile.history_reports(_history(spark, sf), SETTINGS))


@query
def recon_details(spark, sf):
    results = _history(spark, sf)
    reports = reconcile.history_reports(results, SETTINGS)
    return reconcile.details(reports, results, "daily").select(
        *COUNT_KEYS, "reference_store", "reference_count", "observed_store", "observed_count",
        "delta", "discrepancy_pct", "auto_patched",
    )


@query
def recon_metrics(spark, sf):
    results = _history(spark, sf)
    return reconcile.run_metrics(reconcile.history_reports(results, SETTINGS), results)


def _run_store(spark, sf) -> run_store.RunStore:
    """An hourly and a daily run, and an hourly one whose store cannot be read."""
    store = run_store.RunStore(spark, new_path(spark, "runs"))
    day = AS_OF - AS_OF % DAY_MS
    store.run("hourly", AS_OF - 2 * HOUR_MS, AS_OF, AS_OF, SETTINGS, lambda: _recon_hourly(spark, sf))
    store.run("daily", day - DAY_MS, day, AS_OF, SETTINGS, lambda: _recon_daily(spark, sf))
    missing = f"{new_path(spark, 'missing')}/warm"
    store.run(
        "hourly", AS_OF - 3 * HOUR_MS, AS_OF - HOUR_MS, AS_OF - HOUR_MS, SETTINGS,
        lambda: reconcile.hourly(spark.read.parquet(missing), _stores(spark, sf).hot_counts(), SETTINGS),
    )
    return store


@query
def recon_runs(spark, sf):
    """Stored run reports; the time of a run is measured, so only its presence is compared."""
    return _run_store(spark, sf).reports().select(
        "run_id", "window", "status", "run_time_ms", "window_start_ms", "window_end_ms", "campaigns", "discrepancies",
        "auto_patched", (F.col("elapsed_ms") > 0).alias("measured"), (F.col("message") != "").alias("explained"),
    )


@query
def recon_run_metrics(spark, sf):
    """Figures of the stored runs, with the failed one."""
    return _run_store(spark, sf).metrics()


# ---- dead letters -----------------------------------------------------------------------


def _polled(spark, sf):
    return dead_letter.polled(
        _dlq(spark, sf), SETTINGS, tenant="TENANT_1", reason="Missing required field"
    )


@query
def dlq_stats(spark, sf):
    return dead_letter.stats(_dlq(spark, sf))


@query
def dlq_replay(spark, sf):
    return dead_letter.replay(_polled(spark, sf)).select(
        "partition", "offset", "key", "dlq_reason", *FLAT
    )


@query
def dlq_replay_summary(spark, sf):
    return dead_letter.replay_summary(_polled(spark, sf))


@query
def dlq_replay_runs(spark, sf):
    """Two replays of the decoded dead-letter records; the second goes on where the first stopped."""
    log = _dlq(spark, sf)
    store = replay.ReplayStore(spark, new_path(spark, "replays"))
    decoded = kafka.decode_dead_letters(kafka.dead_letter_records(log, ["partition", "offset"]))
    store.run(decoded, "first", SETTINGS, "TENANT_1", "Missing required field", requested=25)
    store.run(decoded, "second", SETTINGS, "TENANT_1", "Missing required field")
    return store.everything().select("partition", "offset", "key", "dlq_reason", "event_id", "user_id", "replayed", "rejected_again")


@query
def avro_round_trip(spark, sf):
    """Events through the framed wire format; every 50th record arrives cut short."""
    wire = [c for c in WIRE_FIELDS.values() if c != "custom_tags"]
    events = canonical(spark, sf)
    records = keep(kafka.encode_avro(events, F.col("seq").cast("string"), schema_id=7), "avro-records")
    broken = F.col("key").cast("bigint") % 50 == 0
    cut = F.when(broken, F.expr("substring(value, 1, length(value) - 3)")).otherwise(F.col("value"))
    good, bad = kafka.decode_avro(records.select(cut.alias("value")))
    none = [F.lit(None).cast(good.schema[c].dataType).alias(c) for c in wire]
    rows = good.select(*wire, F.lit(None).cast("string").alias("dlq_reason"))
    return keep(rows.unionByName(bad.select(*none, "dlq_reason")), "avro-decoded")


@query
def replay_failures(spark, sf):
    everything = dead_letter.polled(_dlq(spark, sf), SETTINGS, requested=0)
    return dead_letter.replay_failures(everything, limit=3)


# ---- monitoring -------------------------------------------------------------------------


@query
def dlq_rate(spark, sf):
    return monitoring.dead_letter_rate(_rejected(spark, sf), warning=0.004, critical=0.01)


@query
def dedup_drop_ratio(spark, sf):
    return monitoring.drop_ratio(_valid(spark, sf), _kept(spark, sf))


@query
def attribution_gaps(spark, sf):
    valid = _valid(spark, sf)
    span = valid.agg(F.min(ms()).alias("from_ms"), F.max(ms()).alias("to_ms"))
    return monitoring.silent_windows(_converted(spark, sf), span)


@query
def cache_hit_ratio(spark, sf):
    return monitoring.cache_hit_ratio(request_log(spark, sf))


@query
def conversion_latency_quantiles(spark, sf):
    rows = _converted(spark, sf).select(
        "tenant_id", attribution.duration_ms().alias("duration_ms")
    )
    found = quantiles.quantiles(
        rows, ["tenant_id"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 60_000
    )
    return found.select("tenant_id", "n", *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")])


@query
def conversion_latency_by_hour(spark, sf):
    """The same quantiles per tenant and hour."""
    hour = E.hour_bucket(ms()).alias("window_start_ms")
    rows = _converted(spark, sf).select(
        "tenant_id", hour, attribution.duration_ms().alias("duration_ms")
    )
    found = quantiles.quantiles(
        rows, ["tenant_id", "window_start_ms"], "duration_ms",
        {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 60_000,
    )
    rounded = [F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")]
    return found.select("tenant_id", "window_start_ms", "n", *rounded)


@query
def latency_histogram_by_hour(spark, sf):
    """Latency quantiles per tenant and hour from the stored bucket counts."""
    rows = _tables(spark, sf).latency.read()
    rows = rows.withColumn("window_start_ms", E.hour_bucket(F.col("minute_ms")))
    found = quantiles.from_histogram(
        rows, ["tenant_id", "window_start_ms"], stored.LATENCY_BOUNDS, {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    )
    return found.select("tenant_id", "window_start_ms", "n", *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")])


@query
def alert_episodes(spark, sf):
    """When the alert rules began to hold, fired and ended."""
    rates = monitoring.dead_letter_rate(_rejected(spark, sf), warning=0.004, critical=0.01)
    ticks = [
        alerts.held(rates, alerts.HIGH_DLQ, "warning", "tenant_id"),
        alerts.held(rates, alerts.CRITICAL_DLQ, "critical", "tenant_id"),
        alerts.held(monitoring.drop_ratio(_valid(spark, sf), _kept(spark, sf)), alerts.HIGH_DROPS, "alert"),
        alerts.held(monitoring.cache_hit_ratio(request_log(spark, sf)), alerts.LOW_HITS, "alert"),
        alerts.held(attribution_gaps(spark, sf), alerts.NO_ATTRIBUTION, "alert"),
    ]
    whole = ticks[0]
    for t in ticks[1:]:
        whole = whole.unionByName(t)
    return alerts.episodes(whole, AS_OF - 2 * DAY_MS)


@query
def ingest_rate_by_type(spark, sf):
    minutes = monitoring.per_minute(_valid(spark, sf), ["event_type"], n=F.lit(1))
    return minutes.withColumn("rate", monitoring.rate("n", 60))


@query
def dlq_rate_by_reason(spark, sf):
    rows = _rejected(spark, sf).withColumn("reason", E.abbreviate(F.col("dlq_reason")))
    minutes = monitoring.per_minute(rows, ["reason"], n=F.lit(1))
    return minutes.withColumn("rate", monitoring.rate("n", 60))


@query
def throughput_per_minute(spark, sf):
    return monitoring.throughput(_valid(spark, sf), _enriched(spark, sf), CONVERSION)


@query
def last_5m_totals(spark, sf):
    now = AS_OF - 6 * HOUR_MS
    recent = ms().between(now - 5 * 60_000, now)
    checked = ingest.checked(canonical(spark, sf)).where(recent)
    accepted = F.col("dlq_reason").isNull()
    totals = checked.agg(
        F.count_if(accepted).alias("ingested"),
        F.count_if(~accepted).alias("dead_lettered"),
        F.lit(0).cast("bigint").alias("attributed"),
    )
    zero = F.lit(0).cast("bigint")
    attributed = _converted(spark, sf).where(recent).agg(F.count("*").alias("attributed"))
    both = totals.unionByName(
        attributed.select(zero.alias("ingested"), zero.alias("dead_lettered"), "attributed")
    )
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


@query
def top_tenants(spark, sf):
    return monitoring.top_groups(_valid(spark, sf), "tenant_id", AS_OF - DAY_MS, AS_OF)


@query
def watermark_lag(spark, sf):
    return late.watermark_lag(canonical(spark, sf), SETTINGS)


@query
def consumer_backlog(spark, sf):
    return monitoring.backlog(canonical(spark, sf), AS_OF - DAY_MS, high=80, critical=500)


@query
def queries_per_tier(spark, sf):
    log = serving.route_table(request_log(spark, sf), SETTINGS)
    minutes = monitoring.per_minute(
        log.withColumnRenamed("ts_ms", "event_timestamp_ms"), ["tier"], n=F.lit(1)
    )
    return minutes.withColumn("rate", monitoring.rate("n", 60))


# ---- lake -------------------------------------------------------------------------------


@query
def retention_purge(spark, sf):
    """Rows that stay, per dataset and date."""
    sets = {
        "raw": canonical(spark, sf),
        "dlq": _rejected(spark, sf),
        "enriched": _enriched(spark, sf),
        "warm": _enriched(spark, sf),
    }
    parts = [
        lake.with_date(lake.retained(rows, name, SETTINGS)).select(
            F.lit(name).alias("dataset"), F.col("event_date").cast("string").alias("event_date")
        )
        for name, rows in sets.items()
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return A.counts(whole, ["dataset", "event_date"])


@query
def tenant_export(spark, sf):
    rows = lake.exported(_enriched(spark, sf), "tenant_3", "2024-01-05", "2024-01-20")
    return rows.select(*FLAT, F.col("event_date").cast("string").alias("event_date"))


@query
def late_events(spark, sf):
    return late.late(canonical(spark, sf), SETTINGS).select(
        "seq", "source_partition", "event_timestamp_ms", "arrival_ms", "max_before"
    )


@query
def late_upsert(spark, sf):
    """Late rows merged into the (tenant, date) partitions of the valid events they touch."""
    valid = _valid(spark, sf)
    on_time = valid.where(F.col("arrival_ms") - ms() < SETTINGS.allowed_lateness_ms)
    too_late = valid.where(F.col("arrival_ms") - ms() >= SETTINGS.allowed_lateness_ms)
    return lake.merged(on_time, too_late, SETTINGS).select(*FLAT)


def _lake(spark, sf) -> str:
    """A lake of the enriched events."""
    path = new_path(spark, "lake")
    lake.append(_enriched(spark, sf), path)
    return path


@query
def lake_scan(spark, sf):
    """A tenant and window read from the stored lake: only its partitions are opened."""
    rows = lake.scan(spark, _lake(spark, sf), TENANT, AS_OF - 12 * DAY_MS, AS_OF - 5 * DAY_MS)
    return rows.select(*FLAT, F.col("event_date").cast("string").alias("event_date"))


@query
def lake_series(spark, sf):
    """The cold series of every campaign of a tenant, by whole dates of the stored lake."""
    rows = lake.whole(spark, _lake(spark, sf)).where(F.col("tenant_id") == TENANT)
    found = S.cold_series(
        A.countable(rows), AS_OF - 20 * DAY_MS, AS_OF - 5 * DAY_MS, "hour", COUNT_KEYS
    )
    return found.select(*COUNT_KEYS, "bucket_ms", "value")


@query
def lake_erase(spark, sf):
    """What is left per tenant and date after a tenant was erased and old dates were purged."""
    path = _lake(spark, sf)
    lake.erase(spark, path, TENANT)
    lake.purge(spark, path, "dlq", SETTINGS)
    left = lake.whole(spark, path).withColumn("event_date", F.col("event_date").cast("string"))
    return A.counts(left, ["tenant_id", "event_date"])


@query
def lake_upsert(spark, sf):
    """A lake of the valid events that came in time, after the late ones were merged into it."""
    path = new_path(spark, "lake")
    valid = _valid(spark, sf)
    delay = F.col("arrival_ms") - ms()
    lake.append(valid.where(delay < SETTINGS.allowed_lateness_ms), path)
    late_rows = valid.where(delay >= SETTINGS.allowed_lateness_ms)
    lake.upsert_late(spark, path, late_rows, SETTINGS)
    return lake.whole(spark, path).select(*FLAT)


# ---- streams: run over the table's files until all are processed --------------------------

ONCE = {"availableNow": True}


def _finish(stream: DataFrame, folder: str, closing: str | None = None) -> DataFrame:
    """Write a stream to a table until its input is used up, then close it if it has a closing folder."""
    started = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(clock.UNTIL_STOPPED if closing else ONCE))
        .start()
    )
    if closing:
        clock.run_to_end(stream.sparkSession, started, closing)
    else:
        started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def _valid_arrivals(spark, sf, parts: int = 4) -> DataFrame:
    return ingest.valid(arrival_stream(spark, sf, parts)).select(*EVENT_COLUMNS)


def _closed(spark, sf, name: str, operator) -> DataFrame:
    """A stateful operator over the valid events in four micro-batches, then the end of the stream."""
    folder = new_path(spark, name)
    rows = clock.punctual(_valid_arrivals(spark, sf), SETTINGS)
    rows = clock.timed(clock.closable(rows, f"{folder}/closing"), SETTINGS.stream_lateness_ms)
    return _finish(operator(rows, SETTINGS), folder, f"{folder}/closing")


@stream_query
def stream_click_to_basket(spark, sf):
    """Attribution by an interval join of streams over the valid events."""
    return _closed(spark, sf, "stream-conversions", stream_attribution.conversions).select(
        *CONVERSION_COLUMNS,
        attribution.duration_ms().alias("duration_ms"),
        attribution.attributed_click().alias("attributed_click_id"),
    )


@stream_query
def stream_unique_ids(spark, sf):
    """De-duplication in event-time session windows: the ids of all kept events."""
    return _closed(spark, sf, "stream-unique", stream_dedup.unique).select("event_id")


@stream_query
def stream_late(spark, sf):
    """Valid events that a stream with five minutes of patience does not wait for."""
    settings = replace(SETTINGS, stream_lateness_ms=SETTINGS.allowed_lateness_ms)
    behind = clock.late(_valid_arrivals(spark, sf), settings)
    return _finish(behind, new_path(spark, "stream-late")).select(*FLAT)


@stream_query
def stream_counts(spark, sf):
    """Running counts per (tenant, campaign, type)."""
    folder = new_path(spark, "stream-counts")
    stream = _valid_arrivals(spark, sf)
    counters.count_stream(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return counters.current_counts(spark, f"{folder}/rows")


def _stream_job(spark, sf, parts: int, files: int | None = None) -> DataFrame:
    out = job.Folders(new_path(spark, "stream-job"))
    job.run_available(arrival_stream(spark, sf, parts), out, SETTINGS, ends=True, files=files)
    return job.enriched(spark, out).select(*FLAT, attribution.duration_ms().alias("duration_ms"))


@stream_query
def stream_enriched(spark, sf):
    """The whole stream job over four micro-batches: unique events and conversions."""
    return _stream_job(spark, sf, 4)


@stream_query
def stream_enriched_stateful(spark, sf):
    """The same rows when the state of both steps crosses twice as many micro-batches."""
    return _stream_job(spark, sf, 8, files=int(spark.conf.get("spark.sql.shuffle.partitions")))


@stream_query
def stream_hot_counters(spark, sf):
    """The hot counter sink over the valid events, read at ``as_of``."""
    folder = new_path(spark, "stream-counters")
    (
        _valid_arrivals(spark, sf, 8)
        .writeStream.foreachBatch(
            lambda df, batch_id: counters.add_deltas(df, f"{folder}/deltas", batch_id)
        )
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**ONCE)
        .start()
        .awaitTermination()
    )
    return counters.hot_counters(spark, [f"{folder}/deltas"], SETTINGS)
