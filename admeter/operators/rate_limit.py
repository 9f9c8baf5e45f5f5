"""Fixed-window quota per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.model import ORDER
from admeter.operators.ordered import row_number


#: Spans that the requests of one window are numbered in.
SPANS = 16


def quota_of(tenant: Column, overrides: dict[str, int], settings: Settings) -> Column:
    """Quota of a tenant; the overrides are configuration, so they are part of the plan."""
    default = F.lit(settings.quota_default)
    if not overrides:
        return default
    table = F.create_map(*[F.lit(x) for item in overrides.items() for x in item])
    return F.coalesce(F.element_at(table, tenant), default)


def window_no(ms: Column, settings: Settings) -> Column:
    return F.floor(F.floor(ms / 1000) / settings.quota_window_s).cast("bigint")


def admission(events: DataFrame, overrides: dict[str, int], settings: Settings) -> DataFrame:
    """Each request with its position in (tenant, window) and whether it is admitted."""
    rows = events.withColumn("window_no", window_no(F.col("event_timestamp_ms"), settings))
    keys = ["tenant_id", "window_no"]
    width = max(1, settings.quota_window_s * 1000 // SPANS)
    numbered = row_number(rows, keys, ORDER, "position", width)
    quota = quota_of(F.col("tenant_id"), overrides, settings)
    admitted = (F.col("position") <= quota) if settings.quota_enforced else F.lit(True)
    return numbered.withColumns({"quota": quota, "admitted": admitted})


def remaining(events: DataFrame, overrides: dict[str, int], settings: Settings) -> DataFrame:
    """Quota left per (tenant, window) after all its requests."""
    bucket = window_no(F.col("event_timestamp_ms"), settings).alias("window_no")
    quota = quota_of(F.col("tenant_id"), overrides, settings)
    used = events.groupBy("tenant_id", bucket).agg(F.count("*").alias("used"))
    left = F.greatest(F.lit(0).cast("bigint"), quota - F.col("used"))
    return used.withColumn("remaining", left)
