"""Rates and ratios over time. Everything is first summed per minute, then over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.config import MINUTE_MS


#: Windows of a range that one task makes.
RUN = 10_000


def minute_of(ms: str | Column) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return (c - F.pmod(c, F.lit(MINUTE_MS))).alias("minute_ms")


def per_minute(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Sums per minute of event time."""
    return rows.groupBy(*keys, minute_of("event_timestamp_ms")).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()]
    )


def sliding(minutes: DataFrame, keys: list[str], names: list[str], width: int) -> DataFrame:
    """Sums over every window of ``width`` minutes that starts at a full minute.

    Minutes, not events, are copied into the windows that hold them.
    """
    first = F.col("minute_ms") - (width - 1) * MINUTE_MS
    starts = F.sequence(first, F.col("minute_ms"), F.lit(MINUTE_MS).cast("bigint"))
    return (
        minutes.withColumn("window_start_ms", F.explode(starts))
        .groupBy(*keys, "window_start_ms")
        .agg(*[F.sum(n).alias(n) for n in names])
    )


def rate(count: str, seconds: int) -> Column:
    return F.col(count).cast("double") / F.lit(float(seconds))


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def dead_letter_rate(
    rejected: DataFrame, warning: float = 100.0, critical: float = 1000.0
) -> DataFrame:
    """Dead letters per second and tenant over 5 minutes, with the two alert levels."""
    minutes = per_minute(rejected, ["tenant_id"], n=F.lit(1))
    return sliding(minutes, ["tenant_id"], ["n"], 5).select(
        "tenant_id",
        "window_start_ms",
        "n",
        rate("n", 300).alias("rate"),
        (rate("n", 300) > warning).alias("warning"),
        (rate("n", 300) > critical).alias("critical"),
    )


def drop_ratio(received: DataFrame, kept: DataFrame, limit: float = 0.10) -> DataFrame:
    """Duplicates dropped relative to events processed, over 5 minutes."""
    marked = received.select(
        "event_timestamp_ms", F.lit(1).alias("got"), F.lit(0).alias("kept")
    ).unionByName(
        kept.select("event_timestamp_ms", F.lit(0).alias("got"), F.lit(1).alias("kept"))
    )
    minutes = per_minute(marked, [], received=F.col("got"), processed=F.col("kept"))
    windows = sliding(minutes, [], ["received", "processed"], 5)
    dropped = F.col("received") - F.col("processed")
    share = ratio(dropped, F.col("processed"))
    return windows.select(
        "window_start_ms",
        dropped.alias("dropped"),
        "processed",
        share.alias("drop_ratio"),
        F.coalesce(share > limit, F.lit(False)).alias("alert"),
    )


def throughput(received: DataFrame, enriched: DataFrame, conversion: str) -> DataFrame:
    """Processed, dropped and attributed events per minute."""
    is_conversion = F.col("event_type") == conversion
    marked = received.select(
        "event_timestamp_ms", F.lit(1).alias("got"), F.lit(0).alias("kept"), F.lit(0).alias("made")
    ).unionByName(
        enriched.select(
            "event_timestamp_ms",
            F.lit(0).alias("got"),
            F.when(is_conversion, 0).otherwise(1).alias("kept"),
            F.when(is_conversion, 1).otherwise(0).alias("made"),
        )
    )
    minutes = per_minute(
        marked, [], received=F.col("got"), processed=F.col("kept"), attributed=F.col("made")
    )
    dropped = (F.col("received") - F.col("processed")).alias("dropped")
    return minutes.select("minute_ms", "processed", dropped, "attributed")


def silent_windows(
    rows: DataFrame, span: DataFrame, width_min: int = 15, needed: int = 2
) -> DataFrame:
    """Tumbling windows without any row of ``rows``; ``alert`` after ``needed`` in a row.

    ``span`` gives the time range to watch: one row (from_ms, to_ms).
    """
    width = width_min * MINUTE_MS
    start = F.col("event_timestamp_ms") - F.pmod("event_timestamp_ms", F.lit(width))
    counted = rows.groupBy(start.alias("window_start_ms")).agg(F.count("*").alias("n"))
    # the windows of the range, made in runs of RUN by as many tasks as there are runs
    first, last = (F.floor(F.col(c) / width) for c in ("from_ms", "to_ms"))
    runs = span.select(first.alias("a"), last.alias("b"), F.explode(F.sequence(F.floor(first / RUN), F.floor(last / RUN))).alias("run"))
    low, high = F.greatest("a", F.col("run") * RUN), F.least("b", F.col("run") * RUN + RUN - 1)
    every = runs.repartition("run").select(F.explode(F.sequence(low, high)).alias("w"))
    every = every.select((F.col("w") * width).alias("window_start_ms"))
    silent = every.join(counted, "window_start_ms", "left").where(F.coalesce("n", F.lit(0)) == 0)
    silent = silent.select("window_start_ms")
    # a silent window counts for itself and the next ones; with enough of them behind it a window alerts
    reach = F.sequence(F.col("window_start_ms"), F.col("window_start_ms") + (needed - 1) * width, F.lit(width).cast("bigint"))
    behind = silent.select(F.explode(reach).alias("window_start_ms")).groupBy("window_start_ms").agg(F.count("*").alias("quiet"))
    found = silent.join(behind, "window_start_ms")
    return found.select("window_start_ms", F.lit(0).cast("bigint").alias("n"), (F.col("quiet") == needed).alias("alert"))


def cache_hit_ratio(log: DataFrame, limit: float = 0.80) -> DataFrame:
    """Hits over hits and misses, over 5 minutes."""
    hits = F.when(F.col("cache_hit"), 1).otherwise(0)
    minutes = per_minute(
        log.withColumnRenamed("ts_ms", "event_timestamp_ms"), [], hits=hits, lookups=F.lit(1)
    )
    windows = sliding(minutes, [], ["hits", "lookups"], 5)
    share = ratio(F.col("hits"), F.col("lookups"))
    return windows.select(
        "window_start_ms",
        "hits",
        (F.col("lookups") - F.col("hits")).alias("misses"),
        share.alias("hit_ratio"),
        (share < limit).alias("alert"),
    )


def top_groups(rows: DataFrame, key: str, from_ms: int, to_ms: int, n: int = 10) -> DataFrame:
    """The ``n`` groups with the most rows in ``[from, to)``; ties go by name."""
    ms = F.col("event_timestamp_ms")
    return (
        rows.where((ms >= from_ms) & (ms < to_ms))
        .groupBy(key)
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), key)
        .limit(n)
    )


def backlog(log: DataFrame, committed_until_ms: int, high: int, critical: int) -> DataFrame:
    """Rows of each source partition that arrived after the last commit, with alert levels."""
    waiting = F.when(F.col("arrival_ms") > committed_until_ms, 1).otherwise(0)
    return log.groupBy("source_partition").agg(
        F.count("*").alias("end_offset"), F.sum(waiting).alias("lag")
    ).withColumns({"high": F.col("lag") > high, "critical": F.col("lag") > critical})
