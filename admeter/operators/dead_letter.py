"""Statistics and replay of the dead-letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.functions import events as E


def stats(log: DataFrame) -> DataFrame:
    """Earliest and next offset and lag per partition; the row without a partition is the total."""
    per = log.groupBy("partition").agg(
        F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest")
    )
    per = per.withColumn("lag", F.greatest(F.lit(0), F.col("latest") - F.col("earliest")))
    total = per.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("lag")).select(
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("earliest"),
        F.lit(None).cast("bigint").alias("latest"),
        "lag",
    )
    return per.unionByName(total)


def replay_size(requested: int, settings: Settings) -> int | None:
    """Records to read: what was asked for, within the caller's limits; None: all."""
    wanted = requested if requested > 0 else settings.replay_default
    given = [n for n in (wanted, settings.replay_cap) if n is not None]
    return min(given) if given else None


def next_offsets(polled_rows: DataFrame) -> DataFrame:
    """partition, next_offset: where a following replay goes on (``polled``'s ``after``)."""
    return polled_rows.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))


def _not_read(log: DataFrame, after: DataFrame | None) -> DataFrame:
    if after is None:
        return log
    start = after.select(F.col("partition").alias("_partition"), "next_offset")
    rows = log.join(start, F.col("partition") == F.col("_partition"), "left")
    unread = F.col("offset") >= F.coalesce("next_offset", F.lit(0))
    return rows.where(unread).drop("_partition", "next_offset")


def polled(
    log: DataFrame,
    settings: Settings,
    tenant: str | None = None,
    reason: str | None = None,
    requested: int = 0,
    after: DataFrame | None = None,
) -> DataFrame:
    """The records of the log from the offsets in ``after``, each marked replayed or skipped.

    A limit counts records read, not records replayed. A replayed record goes through
    validation again; ``rejected_again`` says what that will find.
    """
    first, size = _not_read(log, after), replay_size(requested, settings)
    if size is not None:
        first = first.orderBy("partition", "offset").limit(size)
    selected = F.col("event_id").isNotNull()
    if tenant is not None:
        selected &= F.lower("key") == tenant.lower()
    if reason is not None:
        selected &= F.coalesce(F.startswith(F.col("dlq_reason"), F.lit(reason)), F.lit(False))
    chosen = F.coalesce(selected, F.lit(False))
    return first.withColumns(
        {"replayed": chosen, "rejected_again": chosen & E.rejection_reason().isNotNull()}
    )


def replay(polled_rows: DataFrame) -> DataFrame:
    """Events to append to the raw table again."""
    return polled_rows.where("replayed").drop("replayed", "rejected_again")


def replay_summary(polled_rows: DataFrame) -> DataFrame:
    return polled_rows.agg(
        F.count_if(F.col("replayed")).alias("replayed"),
        F.count_if(~F.col("replayed")).alias("skipped"),
        F.count_if(F.col("rejected_again")).alias("rejected_again"),
        F.count("*").alias("total"),
    )


def replay_failures(polled_rows: DataFrame, limit: int = 100) -> DataFrame:
    """Replayed records rejected again, per 10 minutes of event time."""
    width = F.lit(600_000)
    start = F.col("event_timestamp_ms") - F.pmod("event_timestamp_ms", width)
    return (
        polled_rows.groupBy(start.alias("window_start_ms"))
        .agg(F.count_if(F.col("rejected_again")).alias("failed"))
        .withColumn("alert", F.col("failed") > limit)
    )
