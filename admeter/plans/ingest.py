"""Write path as batch plans: bind, validate, split, de-duplicate, attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.functions import events as E
from admeter.functions.privacy import redact
from admeter.model import EVENT_COLUMNS
from admeter.operators import attribution, dedup
from admeter.operators.hot_keys import HotKeys, find_hot, find_hot_each


def from_requests(requests: DataFrame, tenant: str | Column, settings: Settings) -> DataFrame:
    """Requests to events: the tenant comes from the caller's verified context, never the payload."""
    tenant = F.lit(tenant) if isinstance(tenant, str) else tenant
    return requests.withColumns(
        {
            "tenant_id": tenant,
            "event_timestamp_ms": E.default_event_time(
                F.col("event_timestamp_ms"), settings.as_of_ms
            ),
        }
    )


def bound(events: DataFrame) -> DataFrame:
    """Rows without a tenant are refused at the edge."""
    return events.where(~E.is_blank(F.col("tenant_id")))


def checked(events: DataFrame) -> DataFrame:
    """Bound rows with the reason for rejection (null when valid) and the normalised type."""
    return bound(events).withColumns(
        {
            "dlq_reason": E.rejection_reason(),
            "normal_type": E.normalize_type(F.col("event_type")),
        }
    )


def valid(events: DataFrame) -> DataFrame:
    """Valid events, with the normalised type stored as the type."""
    return bound(events).where(E.is_valid()).withColumn(
        "event_type", E.known_type(F.col("event_type"))
    )


def rejected(events: DataFrame) -> DataFrame:
    """Rejected events as they go to the dead-letter table: redacted, keyed, with the reason."""
    rows = checked(events).where(F.col("dlq_reason").isNotNull()).drop("normal_type")
    return redact(rows).withColumn("key", E.dlq_key())


IDS = ["event_id"]


def kept(events: DataFrame, settings: Settings) -> DataFrame:
    """Valid and unique events.

    Heavy ids are looked for among the raw rows: that reads one column and no validation.
    """
    return _kept(events, settings, find_hot(events, IDS, settings))


def _kept(events: DataFrame, settings: Settings, hot: HotKeys | None) -> DataFrame:
    return dedup.unique(valid(events).select(*EVENT_COLUMNS), settings, hot)


def converted(events: DataFrame, settings: Settings) -> DataFrame:
    """Conversions among the valid and unique events."""
    ids, sessions = find_hot_each(events, [IDS, attribution.SESSION], settings)
    return attribution.conversions(_kept(events, settings, ids), settings, hot=sessions)


def enriched(events: DataFrame, settings: Settings) -> DataFrame:
    """Valid and unique events plus conversions: the content of the enriched stream."""
    ids, sessions = find_hot_each(events, [IDS, attribution.SESSION], settings)
    return attribution.enrich(_kept(events, settings, ids), settings, hot=sessions)
