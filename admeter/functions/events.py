"""Column expressions over single events. All JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from admeter.config import DAY_MS, HOUR_MS, MINUTE_MS
from admeter.model import EVENT_TYPES, UNSPECIFIED

# Patterns of the request checks.
ID_PATTERN = r"^[A-Za-z0-9_.:-]{1,128}\z"
NOT_BLANK = r"[^\s\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"
# What is trimmed from an event type (control characters and the space).
CONTROLS = "".join(map(chr, range(33)))
INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"
GRAIN_MS = {"minute": MINUTE_MS, "hour": HOUR_MS, "day": DAY_MS}


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return ~F.coalesce(c.rlike(NOT_BLANK), F.lit(False))


def known_type(c: Column) -> Column:
    """Recognised event type after trimming and upper-casing, else null.

    The column is named once, as in ``is_blank``: a filter on it may be pushed below the
    expression that makes the column, and that expression is copied for every mention.
    """
    known = F.create_map(*[F.lit(t) for name in EVENT_TYPES for t in (name, name)])
    return F.element_at(known, F.upper(F.btrim(c, F.lit(CONTROLS))))


def normalize_type(c: Column) -> Column:
    """Recognised event type; anything else, null included, is UNSPECIFIED."""
    return F.coalesce(known_type(c), F.lit(UNSPECIFIED))


def is_valid() -> Column:
    """The event has no rejection reason."""
    return (
        ~is_blank(F.col("event_id"))
        & ~is_blank(F.col("user_id"))
        & ~is_blank(F.col("session_id"))
        & known_type(F.col("event_type")).isNotNull()
    )


def rejection_reason() -> Column:
    """First validation error of an event, or null when it is valid."""
    raw_type = F.col("event_type")
    return F.coalesce(
        F.when(is_blank(F.col("event_id")), F.lit("Missing required field: eventId")),
        F.when(is_blank(F.col("user_id")), F.lit("Missing required field: userId")),
        F.when(is_blank(F.col("session_id")), F.lit("Missing required field: sessionId")),
        F.when(
            known_type(raw_type).isNull(),
            F.concat(
                F.lit("Unrecognized or missing eventType: "),
                F.coalesce(raw_type, F.lit("null")),
            ),
        ),
    )


def field_errors() -> Column:
    """Every violated request constraint, in field order."""
    checks = []
    limited = [("eventId", "event_id"), ("userId", "user_id"), ("sessionId", "session_id")]
    for label, name in limited:
        c = F.col(name)
        checks.append(F.when(is_blank(c), F.lit(f"{label} is required")))
        checks.append(F.when(F.length(c) > 128, F.lit(f"{label} must not exceed 128 characters")))
    checks.append(
        F.when(
            F.length("campaign_id") > 128, F.lit("campaignId must not exceed 128 characters")
        )
    )
    checks.append(F.when(is_blank(F.col("event_type")), F.lit("eventType is required")))
    checks.append(F.when(F.col("cost") < 0, F.lit("cost must be non-negative")))
    return F.array_compact(F.array(*checks))


def default_event_time(c: Column, now_ms: int) -> Column:
    """A request without an event time (null or 0) gets the time of the job."""
    return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(now_ms)).otherwise(c).cast("bigint")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("null"))


def raw_key() -> Column:
    return F.concat_ws(":", _text("tenant_id"), _text("session_id"))


def enriched_key() -> Column:
    return F.concat_ws(":", _text("tenant_id"), _text("campaign_id"))


def dlq_key() -> Column:
    return F.coalesce(F.col("tenant_id"), F.lit("unknown"))


def counter_key() -> Column:
    return F.concat_ws(":", F.lit("campaign"), _text("tenant_id"), _text("campaign_id"))


def series_key() -> Column:
    return F.concat_ws(
        ":", F.lit("ts"), _text("tenant_id"), _text("campaign_id"), _text("event_type")
    )


def hour_bucket(ms: Column) -> Column:
    """Start of the hour, with the division truncating toward zero."""
    return ms - ms % F.lit(HOUR_MS)


def truncate_ms(ms: Column, grain: str) -> Column:
    """Start of the minute, hour or UTC day that holds an epoch-ms instant."""
    return ms - F.pmod(ms, F.lit(GRAIN_MS[grain]))


def event_date(ms: Column) -> Column:
    """UTC calendar date (the session time zone is UTC)."""
    return F.to_date(F.timestamp_millis(ms))


def event_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def label(c: Column) -> Column:
    """Metric label: blank becomes ``unknown``."""
    return F.when(is_blank(c), F.lit("unknown")).otherwise(c)


def abbreviate(c: Column) -> Column:
    """Metric label for free text: cut to 77 characters and dots when longer than 80."""
    return (
        F.when(c.isNull(), F.lit("unknown"))
        .when(F.length(c) > 80, F.concat(F.substring(c, 1, 77), F.lit("...")))
        .otherwise(c)
    )


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID_PATTERN), F.lit(False))


def parse_instant_ms(c: Column) -> Column:
    """ISO-8601 instant to epoch ms; blank or malformed text gives null."""
    return F.when(c.rlike(INSTANT_PATTERN), F.unix_millis(F.try_to_timestamp(c)))


def iso_instant(ms: Column) -> Column:
    """``2024-01-01T00:00:00Z``; a fraction is shown only when there is one."""
    ts = F.timestamp_millis(ms)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.pmod(ms, F.lit(1000)) == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )


def pct_text(c: Column) -> Column:
    return F.format_string("%.4f", c)


def money(c: Column) -> Column:
    """Costs are summed as decimals so that totals do not depend on the order of rows."""
    return c.cast("decimal(18,2)")
