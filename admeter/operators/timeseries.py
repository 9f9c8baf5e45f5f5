"""Series of counts per minute, hour or day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.functions import events as E


def bucketed(rows: DataFrame, grain: str, keys: list[str] = [], weight: str | None = None) -> DataFrame:
    """Rows, or the sum of their weights, per bucket."""
    bucket = E.truncate_ms(F.col("event_timestamp_ms"), grain).alias("bucket_ms")
    value = F.sum(weight) if weight else F.count("*")
    return rows.groupBy(*keys, bucket).agg(value.alias("value"))


def warm_series(rows: DataFrame, from_ms: int, to_ms: int, grain: str, keys=[]) -> DataFrame:
    """Buckets of ``from <= t <= to`` at millisecond precision."""
    inside = rows.where(F.col("event_timestamp_ms").between(from_ms, to_ms))
    return bucketed(inside, grain, keys)


def cold_series(rows: DataFrame, from_ms: int, to_ms: int, grain: str, keys=[]) -> DataFrame:
    """Buckets of whole UTC dates, both ends included. Unknown grains mean hour.

    The bounds are on ``event_date`` where the table has it, so that partitions are pruned.
    """
    grain = clean_grain(grain)
    day = (
        F.col("event_date")
        if "event_date" in rows.columns
        else E.event_date(F.col("event_timestamp_ms"))
    )
    first, last = (E.event_date(F.lit(ms)) for ms in (from_ms, to_ms))
    return bucketed(rows.where(day.between(first, last)), grain, keys)


def hot_series(series: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Stored hourly buckets whose start lies in ``[from, to]``; the grain plays no part."""
    return series.where(F.col("bucket_ms").between(from_ms, to_ms)).withColumnRenamed(
        "cnt", "value"
    )


def clean_grain(grain: str | None) -> str:
    name = (grain or "hour").lower()
    return name if name in E.GRAIN_MS else "hour"


def spine(from_ms: Column, to_ms: Column, grain: str, cap: int | None = None) -> Column:
    """Array of bucket starts from ``from`` cut to the grain while <= ``to``, all or the first ``cap``."""
    step = E.GRAIN_MS[clean_grain(grain)]
    start = E.truncate_ms(from_ms, clean_grain(grain))
    stop = to_ms if cap is None else F.least(to_ms, start + F.lit((cap - 1) * step))
    return F.when(start <= to_ms, F.sequence(start, stop, F.lit(step).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def even_split(
    total: Column, from_ms: Column, to_ms: Column, grain: str, cap: int | None = None
) -> Column:
    """Array of (bucket_ms, value): the total spread evenly, the remainder in the last bucket.

    Without any bucket the whole total sits at ``to``.
    """
    buckets = spine(from_ms, to_ms, grain, cap)
    n = F.size(buckets).cast("bigint")
    each, rest = F.floor(total / n).cast("bigint"), total % n
    points = F.transform(
        buckets,
        lambda b, i: F.struct(
            b.alias("bucket_ms"),
            (each + F.when(i == n - 1, rest).otherwise(F.lit(0))).cast("bigint").alias("value"),
        ),
    )
    at_end = F.array(F.struct(to_ms.alias("bucket_ms"), total.cast("bigint").alias("value")))
    return F.when(n > 0, points).otherwise(at_end)
