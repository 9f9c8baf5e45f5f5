"""Click-to-basket attribution.

Each add-to-cart goes to the latest click before it in the same session, at most the
attribution window later, and only the first cart after a click counts. Among clicks and
carts in time order this means: a cart converts iff the row right before it is a click and
near enough. (If that row is a cart, it has either taken the click or was already too late.)
So one ordered pass per session is enough; there is no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.model import CONVERSION, EVENT_COLUMNS, ORDER
from admeter.operators.hot_keys import HotKeys, previous_match

# Keys of a session. (The tenant is not part of it; pass other keys to change that.)
SESSION = ["session_id"]


def _relevant() -> Column:
    return F.col("event_type").isin("CLICK", "ADD_TO_CART")


def _with_previous(events: DataFrame, keys: list[str], settings: Settings, hot: HotKeys | None) -> DataFrame:
    click = F.struct("event_type", "event_id", "campaign_id", "cost", "event_timestamp_ms")
    return previous_match(events, keys, ORDER, _relevant(), click, "_prev", settings, hot)


def converts(settings: Settings) -> Column:
    delta = F.col("event_timestamp_ms") - F.col("_prev.event_timestamp_ms")
    return (
        (F.col("event_type") == "ADD_TO_CART")
        & (F.col("_prev.event_type") == "CLICK")
        & delta.between(0, settings.attribution_window_ms)
        & F.col("session_id").isNotNull()
    )


def conversion_of() -> dict[str, Column]:
    """Columns of the conversion made from a cart and the click in ``_prev``."""
    delta = F.col("event_timestamp_ms") - F.col("_prev.event_timestamp_ms")
    made = {
        "event_id": F.concat("event_id", F.lit("_att")),
        "campaign_id": F.col("_prev.campaign_id"),
        "event_type": F.lit(CONVERSION),
        "cost": F.col("_prev.cost"),
        "custom_tags": F.create_map(
            F.lit("durationMs"), delta.cast("string"),
            F.lit("attributedClickId"), F.col("_prev.event_id"),
        ),
        "placement_id": F.lit(None).cast("string"),
        "geo_country": F.lit(None).cast("string"),
        "device_type": F.lit(None).cast("string"),
    }
    return {c: made.get(c, F.col(c)) for c in EVENT_COLUMNS}


def conversions(
    kept: DataFrame, settings: Settings, keys: list[str] = SESSION, hot: HotKeys | None = None
) -> DataFrame:
    """Only the conversions. Clicks and carts alone are shuffled, by session."""
    rows = kept.where(_relevant()).select(*EVENT_COLUMNS)
    paired = _with_previous(rows, keys, settings, hot).where(converts(settings))
    return paired.select(*[c.alias(name) for name, c in conversion_of().items()])


def enrich(
    kept: DataFrame,
    settings: Settings,
    keys: list[str] = SESSION,
    hot: HotKeys | None = None,
) -> DataFrame:
    """All unique events and the conversions among them, from one pass over ``kept``."""
    rows = _with_previous(kept.select(*EVENT_COLUMNS), keys, settings, hot)
    itself = F.struct(*EVENT_COLUMNS)
    made = F.struct(*[c.alias(name) for name, c in conversion_of().items()])
    both = F.when(converts(settings), F.array(itself, made)).otherwise(F.array(itself))
    return rows.select(F.inline(both))


def duration_ms() -> Column:
    return F.col("custom_tags")["durationMs"].cast("bigint")


def attributed_click() -> Column:
    return F.col("custom_tags")["attributedClickId"]
