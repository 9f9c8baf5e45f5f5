"""Click-to-basket attribution on a stream: windows, a stream-stream interval join, an aggregate.

A cart converts iff the click or cart right before it in its session is a click, near enough
(``operators/attribution.py``). Clicks and carts are first gathered per session and minute; inside a
minute the row before is at hand. Each minute that starts with a cart then meets, in an interval join over
the attribution window, the last row of every earlier minute of its session, and the latest of these is what
its first row follows. A session takes part with at most one row per minute, so what the join makes of it is
bounded by its minutes, however many events it has; the join also goes by spans as long as it reaches back, so
that a session meets itself a day at a time, however many days a micro-batch has. All state is Spark's,
cleaned by the watermark; conversions come out when the watermark has passed their minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeter.config import MINUTE_MS, Settings
from admeter.model import EVENT_COLUMNS, ORDER
from admeter.operators.attribution import conversion_of, converts

#: What a conversion takes over from its cart and click.
_CARRIED = [*ORDER, *[c for c in EVENT_COLUMNS if c not in (*ORDER, "session_id", "custom_tags")]]
#: What a cart needs of the row before it.
_BEFORE = [*ORDER, "event_id", "event_type", "campaign_id", "cost"]


def conversions(timed: DataFrame, settings: Settings) -> DataFrame:
    """Conversions (``EVENT_COLUMNS``) among unique events with ``event_ts`` and its watermark."""
    relevant = timed.where(F.col("event_type").isin("CLICK", "ADD_TO_CART") & F.col("session_id").isNotNull())
    minutes = relevant.groupBy("session_id", F.window("event_ts", "1 minute"))
    at = F.window_time("window")
    reach = settings.attribution_window_ms // MINUTE_MS + 1
    rows = F.sort_array(F.collect_list(F.struct(*_CARRIED))).alias("rows")
    # minutes without a cart convert nothing
    carts = minutes.agg(rows).where(F.exists("rows", lambda r: r["event_type"] == "ADD_TO_CART"))
    needs = F.element_at("rows", 1)["event_type"] == "ADD_TO_CART"
    # what a minute looks back at lies in its own span or the one before
    here = carts.withColumn("at", at).select("session_id", "at", "rows", F.explode(_spans(F.col("at"), reach, needs)).alias("span"))
    last = minutes.agg(F.max(F.struct(*_BEFORE)).alias("row")).withColumn("earlier", at)
    before = last.select(
        F.col("session_id").alias("session"), "earlier", "row", _span(F.col("earlier"), reach).alias("its_span")
    )
    near = (F.col("earlier") < F.col("at")) & (F.col("earlier") >= F.col("at") - F.expr(f"INTERVAL '{reach}' MINUTE"))
    same = (F.col("session_id") == F.col("session")) & (F.col("span") == F.col("its_span"))
    joined = here.join(before, same & near & needs, "left_outer")
    # the join gives each minute once per earlier minute, or once alone, for each of its spans
    useful = joined.where(F.col("row").isNotNull() | (F.size("rows") > 1))
    latest = useful.groupBy("session_id", "at").agg(F.first("rows").alias("rows"), F.max("row").alias("before"))
    return latest.select("session_id", F.inline(_pairs())).where(converts(settings)).select(
        *[c.alias(name) for name, c in conversion_of().items()]
    )


def _span(at: Column, minutes: int) -> Column:
    """Number of the span of so many minutes."""
    return F.floor(F.unix_millis(at) / F.lit(minutes * MINUTE_MS))


def _spans(at: Column, minutes: int, two: Column) -> Column:
    own = _span(at, minutes)
    return F.when(two, F.array(own, own - 1)).otherwise(F.array(own))


def _pairs() -> Column:
    """Every row of a minute with the row before it, as ``_prev``."""
    rows = F.col("rows")
    return F.transform(
        rows,
        lambda r, i: F.struct(
            *[r[c].alias(c) for c in _CARRIED],
            F.when(i == 0, F.col("before")).otherwise(_before(F.get(rows, i - 1))).alias("_prev"),
        ),
    )


def _before(row: Column) -> Column:
    return F.struct(*[row[c].alias(c) for c in _BEFORE])
