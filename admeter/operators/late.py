"""Rows that arrive late, and how far event time trails arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeter.config import MINUTE_MS, Settings
from admeter.operators.ordered import running_max_before

SOURCE = ["source_partition"]
ARRIVAL = ["arrival_ms", "seq"]


def with_progress(events: DataFrame, settings: Settings) -> DataFrame:
    """Add ``max_before``: the largest event time that its source partition delivered before.

    There are few source partitions and each holds a large part of the table, so their rows are
    cut into spans of arrival.
    """
    return running_max_before(
        events, SOURCE, ARRIVAL, "event_timestamp_ms", "max_before", settings.hot_span_ms
    )


def late(events: DataFrame, settings: Settings) -> DataFrame:
    """Rows more than the allowed lateness behind the newest event time seen before them."""
    behind = F.col("max_before") - F.col("event_timestamp_ms")
    return with_progress(events, settings).where(behind > settings.allowed_lateness_ms)


def watermark_lag(events: DataFrame, settings: Settings) -> DataFrame:
    """Largest distance of arrival from event-time progress, per source partition and minute."""
    seen = F.greatest("max_before", "event_timestamp_ms")
    lag = F.col("arrival_ms") - seen
    minute = F.col("arrival_ms") - F.pmod("arrival_ms", F.lit(MINUTE_MS))
    return (
        with_progress(events, settings)
        .groupBy("source_partition", minute.alias("minute_ms"))
        .agg(F.max(lag).alias("max_lag_ms"))
        .withColumn("alert", F.col("max_lag_ms") > settings.allowed_lateness_ms)
    )
