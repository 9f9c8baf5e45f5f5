"""De-duplication on a stream with the rule of the batch operator, in Spark's own state.

Rows of one id that are more than the TTL apart never have an anchor in common. So an event-time
session window with a gap just above the TTL holds every row that can decide about another; when the
watermark has passed it, the fold of the batch operator picks the rows that stay. State is one value
per open id: the rows of its window. A row comes out a TTL and the lateness after the last row of its
id, at the earliest; an id redelivered again and again within the TTL stays open until that ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.functions import events as E
from admeter.model import EVENT_COLUMNS
from admeter.operators.dedup import kept_rows


def unique(timed: DataFrame, settings: Settings) -> DataFrame:
    """Kept rows (``EVENT_COLUMNS``) of a stream with ``event_ts`` and its watermark."""
    others = [c for c in EVENT_COLUMNS if c != "event_id"]
    gap = f"{settings.dedup_ttl_ms + 1} milliseconds"
    # the state is kept in the order of its keys, and a look-up walks over keys deleted right after it; by a
    # hash these lie among live ones, by id (as old as its number) they would be one long run
    spread = F.xxhash64("event_id").alias("_spread")
    chains = timed.groupBy(spread, "event_id", F.session_window("event_ts", gap)).agg(
        F.collect_list(F.struct(*others)).alias("_rows")
    )
    kept = kept_rows(F.col("_rows"), settings.dedup_ttl_ms)
    return chains.select("event_id", F.inline(kept)).select(*EVENT_COLUMNS)


def within_watermark(events: DataFrame, settings: Settings) -> DataFrame:
    """The built-in operator: rows come out at once, but an id is forgotten with the watermark.

    Copies that come later than that stay, and which copy of a micro-batch stays is open.
    """
    return (
        events.withColumn("event_ts", E.event_ts(F.col("event_timestamp_ms")))
        .withWatermark("event_ts", f"{settings.dedup_ttl_ms} milliseconds")
        .dropDuplicatesWithinWatermark(["event_id"])
    )
