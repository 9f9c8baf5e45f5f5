"""Event time on streams: the watermark, rows that it would lose, and the end of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from admeter.config import MINUTE_MS, Settings
from admeter.functions import events as E
from admeter.model import EVENT_SCHEMA

#: Event time of the row that closes a stream; no event is dated later.
CLOSING_MS = 4_102_444_800_000  # 2100-01-01T00:00:00Z
#: Rows dated further ahead of their arrival than this are not believed.
AHEAD_MS = MINUTE_MS


def _delay() -> Column:
    """How long after its event time a row arrived; without an arrival time 0."""
    at = F.col("event_timestamp_ms")
    return F.coalesce(F.col("arrival_ms") - at, F.lit(0))


def punctual(events: DataFrame, settings: Settings) -> DataFrame:
    """Rows that the watermark cannot lose when rows are read in the order of arrival.

    The watermark trails the newest event time by ``stream_lateness_ms``. No believed event is newer
    than its arrival, so a row that is at most that late is never behind the watermark.
    """
    at = F.col("event_timestamp_ms")
    in_time = _delay().between(-AHEAD_MS, settings.stream_lateness_ms) & (at < CLOSING_MS)
    return events.where(F.coalesce(in_time, F.lit(False)))


def late(events: DataFrame, settings: Settings) -> DataFrame:
    """The other rows: too late, dated ahead, or without a time. They miss nothing but the streams."""
    at = F.col("event_timestamp_ms")
    in_time = _delay().between(-AHEAD_MS, settings.stream_lateness_ms) & (at < CLOSING_MS)
    return events.where(~F.coalesce(in_time, F.lit(False)))


def timed(events: DataFrame, delay_ms: int) -> DataFrame:
    """Adds ``event_ts`` and its watermark."""
    at = E.event_ts(F.col("event_timestamp_ms"))
    return events.withColumn("event_ts", at).withWatermark("event_ts", f"{delay_ms + AHEAD_MS} milliseconds")


def _closing_row(spark: SparkSession, n: int) -> DataFrame:
    given = {"event_timestamp_ms": F.lit(CLOSING_MS), "event_id": F.lit("closing"), "event_type": F.lit("CLICK"), "session_id": F.lit("closing")}
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    return spark.range(n).select(*columns)


def closable(events: DataFrame, folder: str) -> DataFrame:
    """``events`` (columns of ``EVENT_SCHEMA``) and what ``close`` puts into ``folder``."""
    spark = events.sparkSession
    _closing_row(spark, 0).write.mode("ignore").parquet(folder)
    return events.unionByName(spark.readStream.schema(EVENT_SCHEMA).parquet(folder))


def close(spark: SparkSession, folder: str) -> None:
    """End a stream: one row far ahead lets the watermark pass all that is still open.

    The row itself stays open, so it never comes out. Call it when all rows have been read, then
    start the stream once more, or let it go on.
    """
    _closing_row(spark, 1).coalesce(1).write.mode("append").parquet(folder)


#: The trigger of a query that ``run_to_end`` ends.
UNTIL_STOPPED = {"processingTime": "0 seconds"}


def run_to_end(spark: SparkSession, query: StreamingQuery, folder: str) -> None:
    """Let a running query take in all that is there, close its stream and stop it.

    It is not started twice: a start reads the state anew from the logs of all its changes.
    """
    try:
        query.processAllAvailable()
        close(spark, folder)
        query.processAllAvailable()
    finally:
        query.stop()
