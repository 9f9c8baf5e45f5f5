"""Keys that hold a large share of all rows: finding them, keeping them apart.

``find_hot`` counts a sample of the rows per key and names the heavy keys. The sample only decides
which plan a key takes; every row is processed in either plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.operators import ordered
from admeter.sources.shared import keep


@dataclass(frozen=True)
class HotKeys:
    """Heavy keys as a table, their number, and about how many rows they hold together."""

    table: DataFrame
    keys: int
    rows: int


def find_hot(df: DataFrame, keys: list[str], settings: Settings) -> HotKeys | None:
    """Keys with more than about ``hot_key_rows`` rows, or None when there are none."""
    return find_hot_each(df, [keys], settings)[0]


def find_hot_each(
    df: DataFrame, key_sets: list[list[str]], settings: Settings
) -> list[HotKeys | None]:
    """``find_hot`` for several sets of keys in one job (grouping sets over one sample)."""
    share = settings.hot_key_sample
    columns = list(dict.fromkeys(k for keys in key_sets for k in keys))
    seen = df.select(*columns)
    if share < 1.0:
        seen = seen.sample(share, seed=7)
    heavy = (
        seen.groupingSets([[F.col(k) for k in keys] for keys in key_sets], *columns)
        .agg(F.count("*").alias("_seen"), F.grouping_id().cast("bigint").alias("_set"))
        .where(F.col("_seen") > settings.hot_key_rows * share)
    )
    # The result is at most (key sets * all rows / hot_key_rows) long; it comes to the driver
    # only up to the size that may be broadcast, else it stays on the cluster.
    found = heavy.limit(settings.broadcast_rows + 1).collect()
    if not found:
        return [None for _ in key_sets]
    if len(found) <= settings.broadcast_rows:
        table = df.sparkSession.createDataFrame(found, heavy.schema)
    else:
        table = keep(heavy, "hot-keys")
    return [_hot_of(table, columns, keys, share) for keys in key_sets]


def _hot_of(table: DataFrame, columns: list[str], keys: list[str], share: float) -> HotKeys | None:
    last = len(columns) - 1
    set_id = sum(1 << (last - i) for i, c in enumerate(columns) if c not in keys)
    own = table.where(F.col("_set") == set_id)
    total = own.agg(F.count("*").alias("n"), F.sum("_seen").alias("rows")).first()
    if total["n"] == 0:
        return None
    return HotKeys(own.select(*keys), total["n"], int(total["rows"] / share))


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, how)


SALTS = 64


def keep_keys(
    rows: DataFrame, listed: DataFrame, n: int, keys: list[str], settings: Settings, how: str
) -> DataFrame:
    """Semi or anti join of rows with a table of ``n`` distinct keys.

    A small table is broadcast. A larger one is copied ``SALTS`` times with a salt, and each row
    looks under one salt, so that a key with very many rows is spread over as many tasks.
    """
    if n <= settings.broadcast_rows:
        return match(rows, F.broadcast(listed), keys, how)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copies = listed.withColumn("_salt", F.explode(salts))
    # maps cannot be hashed; the other columns spread the rows of a key well enough
    hashed = [f.name for f in rows.schema.fields if f.dataType.typeName() != "map"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
    return match(salted, copies, [*keys, "_salt"], how).drop("_salt")


def previous_match(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    where: Column,
    value: Column,
    name: str,
    settings: Settings,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``value`` (a struct) of the latest earlier row of the key that satisfies ``where``.

    Usual keys take one window; heavy ones go through spans of ``hot_span_ms`` (``ordered.py``).
    """
    if hot is not None:
        calm, heavy = (
            keep_keys(df, hot.table, hot.keys, keys, settings, how).select(*df.columns) for how in ("left_anti", "left_semi")
        )
        spanned = ordered.previous_match(heavy, keys, order, where, value, name, settings.hot_span_ms)
        return previous_match(calm, keys, order, where, value, name, settings).unionByName(spanned)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(where, value), ignorenulls=True).over(before))
