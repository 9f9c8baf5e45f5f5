"""The event lake: Parquet by tenant and UTC date, behind a list of live parts (``parts.py``).

Users are pseudonymised before they are written. A write that runs again under its name replaces what
it wrote before; readers see every write, merge and deletion whole or not at all.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.config import DAY_MS, Settings
from admeter.functions import events as E
from admeter.functions.privacy import pseudonymize
from admeter.model import EVENT_COLUMNS, EVENT_SCHEMA, ORDER
from admeter.operators.dedup import first_per_id
from admeter.operators.hot_keys import keep_keys
from admeter.sources.parts import Parts

PARTITIONS = ["tenant_id", "event_date"]
#: What makes two rows the same event: ids are the tenants' own.
ONE_EVENT = ["tenant_id", "event_id"]
LAKE_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.DateType())])
#: Parts of a (tenant, date) beyond which ``compact`` makes one of them.
MOST_PARTS = 8


def table(spark: SparkSession, path: str) -> Parts:
    return Parts(spark, path, tuple(PARTITIONS), LAKE_SCHEMA)


def with_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", E.event_date(F.col("event_timestamp_ms")))


def laid_out(events: DataFrame) -> DataFrame:
    """Rows grouped by (tenant, date) and sorted for the usual filters.

    ``rebalance`` lets Spark split a (tenant, date) that is too large for one writer; every
    file is sorted, so row groups stay selective.
    """
    dated = with_date(events.select(*EVENT_COLUMNS))
    return dated.hint("rebalance", *PARTITIONS).sortWithinPartitions(
        *PARTITIONS, "campaign_id", "event_type", "event_timestamp_ms"
    )


def private(events: DataFrame) -> DataFrame:
    """Events as they may be stored: the user is a pseudonym."""
    return events.withColumn("user_id", pseudonymize(F.col("user_id")))


def append(events: DataFrame, path: str, part: str | None = None) -> None:
    """Add events; a given ``part`` is replaced where it is there already."""
    table(events.sparkSession, path).add(laid_out(private(events)), part)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all tenants, for maintenance."""
    return table(spark, path).read()


def day_text(ms: int) -> str:
    return date.fromordinal(date(1970, 1, 1).toordinal() + ms // DAY_MS).isoformat()


def scan(
    spark: SparkSession,
    path: str,
    tenant: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """Events of one tenant and a window ``[from, to]``; only folders of its dates are listed."""
    first = day_text(from_ms) if from_ms is not None else ""
    last = day_text(to_ms) if to_ms is not None else "~"

    def wanted(values: dict) -> bool:
        return values["tenant_id"] == tenant and first <= (values["event_date"] or "") <= last

    rows = table(spark, path).read(wanted).where(F.col("tenant_id") == tenant)
    ms = F.col("event_timestamp_ms")
    if from_ms is not None:
        rows = rows.where((F.col("event_date") >= E.event_date(F.lit(from_ms))) & (ms >= from_ms))
    if to_ms is not None:
        rows = rows.where((F.col("event_date") <= E.event_date(F.lit(to_ms))) & (ms <= to_ms))
    return rows


def retained(events: DataFrame, dataset: str, settings: Settings) -> DataFrame:
    """Rows that the retention of a dataset keeps at ``as_of``."""
    oldest = settings.as_of_ms - settings.retention_ms[dataset]
    return events.where(F.col("event_timestamp_ms") >= oldest)


def exported(events: DataFrame, tenant: str, from_date: str, to_date: str) -> DataFrame:
    """All rows of a tenant over whole dates, both included."""
    dated = events if "event_date" in events.columns else with_date(events)
    inside = F.col("event_date").between(
        F.lit(from_date).cast("date"), F.lit(to_date).cast("date")
    )
    return dated.where((F.col("tenant_id") == tenant) & inside)


def drop_partitions(spark: SparkSession, path: str, wanted) -> int:
    """Delete whole partitions (erase a tenant, or dates past retention); returns their number.

    ``wanted`` gets a partition's values as text. Only the list of parts is read and written;
    ``vacuum`` frees the space.
    """
    return table(spark, path).drop(wanted)


def erase(spark: SparkSession, path: str, tenant: str) -> int:
    """Delete all dates of a tenant, at once and from the disk: readers of older lists lose them too."""
    return table(spark, path).erase(lambda v: v["tenant_id"] == tenant)


def purge(spark: SparkSession, path: str, dataset: str, settings: Settings) -> int:
    """Drop the dates that lie wholly before the retention limit."""
    oldest = day_text(settings.as_of_ms - settings.retention_ms[dataset])
    return drop_partitions(spark, path, lambda v: v["event_date"] is not None and v["event_date"] < oldest)


def merged(existing: DataFrame, late: DataFrame, settings: Settings) -> DataFrame:
    """Existing rows of the partitions that late rows touch, and the late rows, once per (tenant, id)."""
    touched = with_date(late).select(*PARTITIONS).distinct()
    some = touched.limit(settings.broadcast_rows + 1).count()
    dated = existing if "event_date" in existing.columns else with_date(existing)
    affected = keep_keys(dated, touched, some, PARTITIONS, settings, "left_semi")
    both = affected.select(*EVENT_COLUMNS).unionByName(late.select(*EVENT_COLUMNS))
    rest = [c for c in EVENT_COLUMNS if c not in (*ONE_EVENT, *ORDER)]
    as_entries = both.withColumn("custom_tags", F.map_entries("custom_tags"))
    once = first_per_id(as_entries, rest, ONE_EVENT)
    return once.withColumn("custom_tags", F.map_from_entries("custom_tags")).select(
        *EVENT_COLUMNS
    )


def upsert_late(spark: SparkSession, path: str, late: DataFrame, settings: Settings) -> None:
    """Merge late rows by (tenant, id) and replace exactly the partitions they touch, in one step."""
    lake, late = table(spark, path), private(late)
    # one entry per touched (tenant, date)
    days = with_date(late).select("tenant_id", F.col("event_date").cast("string")).distinct().collect()
    touched = {tuple(r) for r in days}
    old = [e for e in lake.live() if (e["values"]["tenant_id"], e["values"]["event_date"]) in touched]
    result = merged(lake.read_entries(old), late, settings)
    lake.replace(old, laid_out(result), f"merge-{uuid.uuid4().hex}")


def compact(spark: SparkSession, path: str, most: int = MOST_PARTS) -> int:
    """One part for every (tenant, date) that lies in more than ``most``; returns how many there were."""
    lake = table(spark, path)
    old = lake.crowded(most)
    if old:
        lake.replace(old, laid_out(lake.read_entries(old)), f"compact-{uuid.uuid4().hex}")
    return len({e["folder"] for e in old})
