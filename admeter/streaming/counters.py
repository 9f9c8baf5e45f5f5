"""Counts kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.config import Settings
from admeter.model import COUNT_KEYS
from admeter.operators import aggregates as A
from admeter.streaming.tables import read_batches, write_batch

KEY_FIELDS = [T.StructField(k, T.StringType()) for k in COUNT_KEYS]
HOURLY_SCHEMA = T.StructType(
    KEY_FIELDS
    + [T.StructField(n, T.LongType()) for n in ("bucket_ms", "cnt", "first_ms", "last_ms")]
)
COUNT_SCHEMA = T.StructType([*KEY_FIELDS, T.StructField("cnt", T.LongType())])


def add_deltas(events: DataFrame, path: str, batch_id: int) -> None:
    """Hot counter sink: the increments of one micro-batch per key and hour."""
    write_batch(A.hourly(events), path, batch_id)


def hourly_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Hourly counts over the deltas of all micro-batches of the given sinks."""
    deltas = None
    for path in paths:
        one = read_batches(spark, path, HOURLY_SCHEMA).drop("batch")
        deltas = one if deltas is None else deltas.unionByName(one)
    return A.merged_hourly(deltas)


def hot_counters(spark: SparkSession, paths: list[str], settings: Settings) -> DataFrame:
    """Counters as a reader sees them at ``as_of``, with the TTL refreshed by every write."""
    return A.counters_of(hourly_counts(spark, paths), settings)


def count_stream(events: DataFrame, path: str, checkpoint: str):
    """Running counts per key as a streaming aggregation; each batch writes the changed keys."""
    counts = A.counts(events.dropna(subset=["campaign_id"]))
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda df, batch_id: write_batch(df, path, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every key."""
    rows = read_batches(spark, path, COUNT_SCHEMA)
    return rows.groupBy(*COUNT_KEYS).agg(F.max_by("cnt", "batch").alias("cnt"))
