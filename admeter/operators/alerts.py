"""Alert state over time: when a rule's condition began to hold, when it fired, when it ended."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeter.config import MINUTE_MS

PENDING, FIRING, RESOLVED = "pending", "firing", "resolved"


@dataclass(frozen=True)
class Rule:
    """Evaluated every ``step_ms``; fires when its condition has held for ``hold_ms``."""

    name: str
    hold_ms: int
    step_ms: int = MINUTE_MS


# How long each condition must hold.
HIGH_DLQ = Rule("HighDlqRate", 2 * MINUTE_MS)
CRITICAL_DLQ = Rule("CriticalDlqRate", 1 * MINUTE_MS)
HIGH_DROPS = Rule("HighDedupDropRate", 5 * MINUTE_MS)
LOW_HITS = Rule("RedisCacheHitRateLow", 10 * MINUTE_MS)
NO_ATTRIBUTION = Rule("AttributionRateDrop", 30 * MINUTE_MS, 15 * MINUTE_MS)


def held(rows: DataFrame, rule: Rule, condition: str, group: str | None = None) -> DataFrame:
    """rule, grp, at_ms, step_ms, hold_ms of the evaluations (``window_start_ms``) at which a condition holds."""
    return rows.where(condition).select(
        F.lit(rule.name).alias("rule"),
        (F.col(group) if group else F.lit("")).alias("grp"),
        F.col("window_start_ms").alias("at_ms"),
        F.lit(rule.step_ms).cast("long").alias("step_ms"),
        F.lit(rule.hold_ms).cast("long").alias("hold_ms"),
    )


def episodes(ticks: DataFrame, as_of_ms: int) -> DataFrame:
    """One row per run of evaluations without a gap: started, fired, resolved and the state at ``as_of_ms``.

    A condition that ends before it has held long enough never fires. A rule and group has at
    most one tick per evaluation, so its window is as long as the time that is looked at.
    """
    order = Window.partitionBy("rule", "grp").orderBy("at_ms")
    island = F.col("at_ms") - F.row_number().over(order) * F.col("step_ms")
    runs = ticks.where(F.col("at_ms") <= as_of_ms).withColumn("island", island)
    runs = runs.groupBy("rule", "grp", "island", "step_ms", "hold_ms").agg(
        F.min("at_ms").alias("started_ms"), F.max("at_ms").alias("last_ms")
    )
    fires = F.col("last_ms") - F.col("started_ms") >= F.col("hold_ms")
    ended = F.col("last_ms") + F.col("step_ms")
    fired = F.when(fires, F.col("started_ms") + F.col("hold_ms"))
    resolved = F.when(ended <= as_of_ms, ended)
    state = F.when(resolved.isNotNull(), RESOLVED).when(fires, FIRING).otherwise(PENDING)
    return runs.select(
        "rule", "grp", "started_ms", fired.alias("fired_ms"), resolved.alias("resolved_ms"), state.alias("state")
    )
