"""Ordered per-key operators for keys of any size: row number, running maximum, previous row.

The order's first column cuts a key's rows into spans of equal width (hours of a time, say). A window
runs inside each (key, span), and what a span needs from the spans before it (a count, a maximum, a last
row) comes from one summary row per (key, span): summaries are aggregated before the shuffle, a window
over a key's spans adds them up, and a join hands them to the rows. Everything is one lazy plan; no key
is treated apart, none is looked for, and a task holds a span at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(
    df: DataFrame, keys: list[str], order: list[str], width: int, summary: Column, fold: Callable[[Column], Column]
) -> DataFrame:
    """Adds ``_at`` (keys and span; a struct, so that null keys are equal) and ``_carry``."""
    span = F.floor(F.col(order[0]) / width).alias("_span")
    rows = df.withColumn("_at", F.struct(*keys, span))
    sums = rows.groupBy("_at").agg(summary.alias("_summary"))
    by_key = Window.partitionBy(*[F.col("_at")[k] for k in keys]).orderBy(F.col("_at")["_span"])
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_at", fold(F.col("_summary")).over(earlier).alias("_carry"))
    return rows.join(sums, "_at")


def _before(order: list[str]):
    return Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def row_number(df: DataFrame, keys: list[str], order: list[str], name: str, width: int) -> DataFrame:
    """1-based position of each row within its key. ``order`` must be unique within a key."""
    rows = _carried(df, keys, order, width, F.count("*"), F.sum)
    local = F.row_number().over(Window.partitionBy("_at").orderBy(*order)).cast("bigint")
    return rows.withColumn(name, local + F.coalesce("_carry", F.lit(0))).drop("_at", "_carry")


def running_max_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int) -> DataFrame:
    """Largest ``value`` among the earlier rows of the key; null for the first row."""
    rows = _carried(df, keys, order, width, F.max(value), F.max)
    best = F.greatest(F.max(value).over(_before(order)), F.col("_carry"))
    return rows.withColumn(name, best).drop("_at", "_carry")


def previous_match(
    df: DataFrame, keys: list[str], order: list[str], where: Column, value: Column, name: str, width: int
) -> DataFrame:
    """``value`` (a struct) of the latest earlier row of the key that satisfies ``where``."""
    chosen = F.when(where, value)
    newest = F.max_by(chosen, F.when(where, F.struct(*order)))
    rows = _carried(df, keys, order, width, newest, lambda c: F.last(c, ignorenulls=True))
    latest = F.coalesce(F.last(chosen, ignorenulls=True).over(_before(order)), F.col("_carry"))
    return rows.withColumn(name, latest).drop("_at", "_carry")
