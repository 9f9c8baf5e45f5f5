"""De-duplication of redelivered events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.model import ORDER
from admeter.operators.hot_keys import HotKeys, keep_keys

SLOT_MS = 32_768  # instants per bitmap


def unique(events: DataFrame, settings: Settings, hot: HotKeys | None) -> DataFrame:
    """Keep an event iff none with its id was *kept* within the TTL before it.

    The kept event is the anchor; duplicates do not extend it, and it expires when more than
    the TTL has passed. Ids are independent, so one shuffle by id is enough. ``hot`` names the
    ids with very many rows (``find_hot``), which take the second path.
    """
    if hot is None:
        return _fold(events, settings.dedup_ttl_ms)
    calm, heavy = (
        keep_keys(events, hot.table, hot.keys, ["event_id"], settings, how)
        for how in ("left_anti", "left_semi")
    )
    return _fold(calm, settings.dedup_ttl_ms).unionByName(_walk(heavy, settings.dedup_ttl_ms))


def _kept_positions(rows: Column, ttl_ms: int) -> Column:
    """Fold over the (time, seq) points of one id; returns the positions in ``rows`` that are kept."""
    points = F.sort_array(
        F.transform(
            rows,
            lambda r, i: F.struct(
                r["event_timestamp_ms"].alias("t"), r["seq"].alias("s"), i.alias("i")
            ),
        )
    )
    state = "struct<anchor:bigint,kept:array<int>>"
    start = F.struct(F.lit(None).alias("anchor"), F.array().alias("kept")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["anchor"].isNull() | (x["t"] - acc["anchor"] > ttl_ms)
        taken = F.struct(
            x["t"].alias("anchor"), F.concat(acc["kept"], F.array(x["i"])).alias("kept")
        )
        return F.when(fresh, taken).otherwise(acc)

    return F.aggregate(points, start, step, lambda acc: acc["kept"])


def _fold(events: DataFrame, ttl_ms: int) -> DataFrame:
    """Ids with a bounded number of rows: one array per id, folded inside the JVM."""
    columns = events.columns
    grouped = (
        events.repartition("event_id")
        .groupBy("event_id")
        .agg(F.collect_list(F.struct(*[c for c in columns if c != "event_id"])).alias("_rows"))
    )
    return grouped.select("event_id", F.inline(kept_rows(F.col("_rows"), ttl_ms))).select(*columns)


def kept_rows(rows: Column, ttl_ms: int) -> Column:
    """The rows (structs) of one id that stay, of an array of all of them."""
    # The fold is the array that is walked, so it runs once per id and not once per row.
    several = F.transform(_kept_positions(rows, ttl_ms), lambda i: F.get(rows, i))
    return F.when(F.size(rows) == 1, rows).otherwise(several)


def _walk(events: DataFrame, ttl_ms: int) -> DataFrame:
    """Ids with any number of rows.

    What the walk needs of an id is the set of its distinct instants, which is one bit per
    millisecond however many rows there are. The bitmaps are built with partial aggregation,
    sorted by time, and read once from front to back; then the kept instants are joined back.
    """
    slot = F.floor(F.col("event_timestamp_ms") / SLOT_MS).cast("bigint")
    bit = F.pmod("event_timestamp_ms", F.lit(SLOT_MS))
    bitmaps = (
        events.select("event_id", slot.alias("slot"), bit.alias("bit"))
        .groupBy("event_id", "slot")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )

    def kept_instants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free_after = None, None
        for batch in batches:
            ids, times = [], []
            for event_id, slot_no, bits in zip(batch["event_id"], batch["slot"], batch["bits"]):
                if event_id != current:
                    current, free_after = event_id, None
                base = slot_no * SLOT_MS
                if free_after is not None and free_after >= base + SLOT_MS - 1:
                    continue
                set_bits = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
                instants = base + np.flatnonzero(set_bits)
                at = 0 if free_after is None else np.searchsorted(instants, free_after, "right")
                while at < len(instants):
                    ids.append(event_id)
                    times.append(int(instants[at]))
                    free_after = times[-1] + ttl_ms
                    at = np.searchsorted(instants, free_after, "right")
            yield pd.DataFrame({"event_id": ids, "event_timestamp_ms": times})

    instants = (
        bitmaps.repartition("event_id")
        .sortWithinPartitions("event_id", "slot")
        .mapInPandas(kept_instants, "event_id string, event_timestamp_ms bigint")
    )
    # a struct's null field sorts first, as in the fold
    first_at = events.groupBy("event_id", "event_timestamp_ms").agg(
        F.min(F.struct("seq")).alias("first")
    )
    accepted = first_at.join(instants, ["event_id", "event_timestamp_ms"], "left_semi").select(
        F.col("event_id").alias("_id"), F.col("event_timestamp_ms").alias("_ms"),
        F.col("first.seq").alias("_seq"),
    )
    same = (
        (F.col("event_id") == F.col("_id")) & (F.col("event_timestamp_ms") == F.col("_ms"))
        & F.col("seq").eqNullSafe(F.col("_seq"))
    )
    kept = events.join(accepted, same, "left_semi").dropDuplicates(["event_id", *ORDER])
    untimed = events.where(F.col("event_timestamp_ms").isNull())
    return kept.unionByName(untimed).select(*events.columns)


def live_keys(kept: DataFrame, settings: Settings) -> DataFrame:
    """Number of ids that the de-duplicator still remembers at ``as_of``."""
    age = F.lit(settings.as_of_ms) - F.col("event_timestamp_ms")
    return kept.where((age >= 0) & (age <= settings.dedup_ttl_ms)).agg(
        F.count("*").alias("live_keys")
    )


def dropped_by(events: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicates dropped per group: all rows minus kept rows, without a join."""
    signed = events.select(*keys, F.lit(1).alias("n")).unionByName(
        kept.select(*keys, F.lit(-1).alias("n"))
    )
    return signed.groupBy(*keys).agg(F.sum("n").alias("dropped")).where(F.col("dropped") > 0)


def first_per_id(
    events: DataFrame, columns: list[str], keys: list[str] = ["event_id"]
) -> DataFrame:
    """Full-history exact de-duplication: the first row of every id.

    A minimum, not a window: partial aggregation folds the copies of an id before the shuffle.
    """
    first = F.min(F.struct(*ORDER, *columns)).alias("_first")
    return events.groupBy(*keys).agg(first).select(*keys, "_first.*")
