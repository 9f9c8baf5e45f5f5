"""Counts, cubes and roll-ups over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.functions import events as E
from admeter.model import COUNT_KEYS

PLACEMENT_DIMS = ["tenant_id", "campaign_id", "event_type", "placement_id"]
GEO_DIMS = ["tenant_id", "campaign_id", "geo_country", "device_type"]
ROLLUP_DIMS = [*PLACEMENT_DIMS, "geo_country", "device_type"]


def counts(events: DataFrame, keys: list[str] = COUNT_KEYS) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("cnt"))


def countable(events: DataFrame) -> DataFrame:
    """Only rows that a counter can hold: tenant, campaign and type are known."""
    return events.dropna(subset=COUNT_KEYS)


def between(events: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Rows of the half-open window ``[from, to)``."""
    ms = F.col("event_timestamp_ms")
    return events.where((ms >= from_ms) & (ms < to_ms))


def grouped_counts(
    events: DataFrame, from_ms: int, to_ms: int, limit: int | None = None
) -> DataFrame:
    """Counts per (tenant, campaign, type) in ``[from, to)``; with a limit, the first groups by key."""
    groups = counts(countable(between(events, from_ms, to_ms)))
    return groups if limit is None else groups.orderBy(*COUNT_KEYS).limit(limit)


def of_campaign(
    events: DataFrame, tenant: str, campaign: str, metric: str, placement: str | None = None
) -> DataFrame:
    """The mandatory tenant filter and the equality filters of a campaign request."""
    rows = events.where(
        (F.col("tenant_id") == tenant)
        & (F.col("campaign_id") == campaign)
        & (F.col("event_type") == metric)
    )
    return rows.where(F.col("placement_id") == placement) if placement else rows


def campaign_count(events: DataFrame, tenant: str, campaign: str, metric: str) -> DataFrame:
    """One row: the count, 0 when there are no rows."""
    return of_campaign(events, tenant, campaign, metric).agg(F.count("*").alias("cnt"))


def hourly(events: DataFrame) -> DataFrame:
    """Counts per key and hour, with the first and last event time in the hour."""
    ms = F.col("event_timestamp_ms")
    return (
        countable(events)
        .groupBy(*COUNT_KEYS, E.hour_bucket(ms).alias("bucket_ms"))
        .agg(F.count("*").alias("cnt"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))
    )


def merged_hourly(deltas: DataFrame) -> DataFrame:
    """Hourly counts from several partial ones (one per micro-batch)."""
    return deltas.groupBy(*COUNT_KEYS, "bucket_ms").agg(
        F.sum("cnt").alias("cnt"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
    )


def _until(events: DataFrame, settings: Settings) -> DataFrame:
    return events.where(F.col("event_timestamp_ms") <= settings.as_of_ms)


def _alive(hours: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    return current_life(hours, keys, settings, settings.as_of_ms)


def current_life(hours: DataFrame, keys: list[str], settings: Settings, as_of_ms: int) -> DataFrame:
    """Hours since the key last came to life, for keys that are alive at ``as_of_ms``.

    A key dies when it is not written for longer than the counter TTL and starts from zero at
    its next write. Such a gap never lies inside one hour, so the hourly rows decide it
    exactly, and a key has at most one window row per hour and type however many events it has.
    """
    ttl = settings.counter_ttl_ms
    ordered = Window.partitionBy(*keys).orderBy("bucket_ms")
    earlier = ordered.rangeBetween(Window.unboundedPreceding, -1)
    same_hour = ordered.rangeBetween(0, 0)
    whole = Window.partitionBy(*keys)
    gap = F.min("first_ms").over(same_hour) - F.max("last_ms").over(earlier)
    starts = F.when(F.col("_gap").isNull() | (F.col("_gap") > ttl), F.col("bucket_ms"))
    return (
        hours.withColumn("_gap", gap)
        .withColumn("_start", F.max(starts).over(whole))
        .withColumn("_last", F.max("last_ms").over(whole))
        .where((F.col("bucket_ms") >= F.col("_start")) & (F.lit(as_of_ms) - F.col("_last") <= ttl))
    )


def hot_counters(events: DataFrame, settings: Settings) -> DataFrame:
    """Counters per (tenant, campaign, type); the life of a counter is per (tenant, campaign)."""
    return counters_of(hourly(_until(events, settings)), settings)


def counters_of(hours: DataFrame, settings: Settings) -> DataFrame:
    alive = _alive(hours, ["tenant_id", "campaign_id"], settings)
    return alive.groupBy(*COUNT_KEYS).agg(F.sum("cnt").alias("cnt"))


def hot_hourly_series(events: DataFrame, settings: Settings) -> DataFrame:
    """Hourly counts per (tenant, campaign, type); each such series lives on its own."""
    return series_of(hourly(_until(events, settings)), settings)


def series_of(hours: DataFrame, settings: Settings) -> DataFrame:
    alive = _alive(hours, COUNT_KEYS, settings)
    return alive.select(*COUNT_KEYS, "bucket_ms", "cnt")


def cube_sums(rows: DataFrame, dims: list[str]) -> DataFrame:
    """All combinations of the dimensions: level, dims, cnt, cost, of rows that have cnt and cost.

    Rows are first summed at the finest grain, so the 2^n expansion works on groups.
    """
    finest = rows.groupBy(*dims).agg(F.sum("cnt").alias("cnt"), F.sum("cost").alias("cost"))
    return finest.cube(*dims).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("cnt").alias("cnt"), F.sum("cost").alias("cost")
    )


def minute_sums(events: DataFrame) -> DataFrame:
    """``minute_rollup`` with exact costs, for tables that are summed further."""
    minute = E.truncate_ms(F.col("event_timestamp_ms"), "minute").alias("minute_ms")
    return events.groupBy(*ROLLUP_DIMS, minute).agg(
        F.count("*").alias("cnt"), F.sum(E.money(F.col("cost"))).alias("cost")
    )


def _cube(events: DataFrame, dims: list[str], with_cost: bool) -> DataFrame:
    """All combinations of the dimensions over events."""
    one = events.select(*dims, F.col("event_id").isNotNull().cast("long").alias("cnt"), E.money(F.col("cost")).alias("cost"))
    cost = [F.col("cost").cast("double").alias("sum_cost")] if with_cost else []
    return cube_sums(one, dims).select(*dims, "level", "cnt", *cost)


def cube_placement(events: DataFrame) -> DataFrame:
    return _cube(events, PLACEMENT_DIMS, with_cost=True)


def cube_geo_device(events: DataFrame) -> DataFrame:
    return _cube(events, GEO_DIMS, with_cost=False)


def cube_lookup(cube: DataFrame, dims: list[str], **fixed: str) -> DataFrame:
    """The one row of a cube that answers an equality query on some dimensions."""
    level = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in fixed)
    rows = cube.where(F.col("level") == level)
    for name, value in fixed.items():
        rows = rows.where(F.col(name) == value)
    return rows


def minute_rollup(events: DataFrame) -> DataFrame:
    """Ingest-time roll-up: rows with equal dimensions in the same minute become one."""
    return minute_sums(events).withColumn("sum_cost", F.col("cost").cast("double")).drop("cost")


def type_breakdown(
    events: DataFrame, tenant: str, campaign: str, from_date: str, to_date: str
) -> DataFrame:
    """Counts by type for one campaign over whole UTC dates, both ends included."""
    day = E.event_date(F.col("event_timestamp_ms"))
    return counts(
        events.where(
            (F.col("tenant_id") == tenant)
            & (F.col("campaign_id") == campaign)
            & day.between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date"))
        ),
        ["event_type"],
    )


def with_fallback(hot: DataFrame, warm: DataFrame) -> DataFrame:
    """Hot count where there is one, else the warm count when positive, else 0."""
    h = hot.select(*COUNT_KEYS, F.col("cnt").alias("hot_cnt"))
    w = warm.select(*COUNT_KEYS, F.col("cnt").alias("warm_cnt"))
    return h.join(w, COUNT_KEYS, "full").select(
        *COUNT_KEYS,
        F.coalesce(
            "hot_cnt", F.when(F.col("warm_cnt") > 0, F.col("warm_cnt")), F.lit(0)
        ).alias("cnt"),
    )


def authorized(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of campaigns that the tenant may see; a tenant without grants may see all."""
    listed = grants.select("tenant_id").distinct().withColumn("_listed", F.lit(True))
    allowed = grants.select("tenant_id", "campaign_id").distinct().withColumn(
        "_allowed", F.lit(True)
    )
    return (
        rows.join(listed, "tenant_id", "left")
        .join(allowed, ["tenant_id", "campaign_id"], "left")
        .where(F.col("_listed").isNull() | F.col("_allowed").isNotNull())
        .select(*rows.columns)
    )
