"""Masking and pseudonyms for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.functions.events import is_blank

# What counts as an e-mail or IPv4 address and what replaces it.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_MASK = "***@***"
# (word boundaries are ASCII, whatever the Java version: look-arounds instead of \b)
IPV4 = r"(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?!\w)"
IPV4_MASK = "***.***.***.***"


def mask(c: Column) -> Column:
    """Hide e-mail and IPv4 addresses in free text; null and empty text stay as they are."""
    # Most texts hold neither; a scan for one character pair spares them the patterns.
    no_mail = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, EMAIL_MASK)).otherwise(c)
    return F.when(c.rlike(r"\d\.\d"), F.regexp_replace(no_mail, IPV4, IPV4_MASK)).otherwise(no_mail)


def pseudonymize(c: Column) -> Column:
    """Stable pseudonym of a value: ``anon_`` and 12 hex digits; null and blank stay as they are."""
    hashed = F.concat(F.lit("anon_"), F.substring(F.sha2(c, 256), 1, 12))
    return F.when(is_blank(c), c).otherwise(hashed)


def redact(events: DataFrame) -> DataFrame:
    """Event as it may be kept in the dead-letter table: no user id, no tags."""
    return events.withColumns(
        {
            "user_id": pseudonymize(F.col("user_id")),
            "custom_tags": F.lit(None).cast("map<string,string>"),
        }
    )
