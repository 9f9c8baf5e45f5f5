"""Exact quantiles without a sort of whole groups and without holding a group in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(
    rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], bin_width: int
) -> DataFrame:
    """Linear-interpolated quantiles of an integer column per group, and the group size ``n``.

    Rows become counts per distinct value (partial aggregation). Values are ranked inside
    bins of ``bin_width``, bins inside the group; a window therefore never holds more than
    ``bin_width`` values, or as many rows as there are bins.
    """
    bin_no = F.floor(F.col(value) / bin_width).cast("bigint")
    values = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, bin_no.alias("_bin"), F.col(value).alias("_value"))
        .agg(F.count("*").alias("_cnt"))
    )
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_value")
    ranked = values.withColumn("_upto", F.sum("_cnt").over(in_bin))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = values.groupBy(*keys, "_bin").agg(F.sum("_cnt").alias("_size"))
    bins = bins.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("n"),
    )
    placed = ranked.join(bins, [*keys, "_bin"]).select(
        *keys,
        "n",
        F.col("_value").cast("double").alias("_value"),
        (F.col("_before") + F.col("_upto") - F.col("_cnt")).alias("_first"),
        (F.col("_before") + F.col("_upto")).alias("_end"),
    )
    aggregates, results = [], []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("_first") <= rank) & (rank < F.col("_end"))
            aggregates.append(F.max(F.when(holds, F.col("_value"))).alias(f"{name}_{side}"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        results.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return placed.groupBy(*keys, "n").agg(*aggregates).select(*keys, "n", *results)


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[int]) -> DataFrame:
    """Counts per key and bucket: ``le`` is the number of the first bound that is not below the value.

    The last bucket, ``len(bounds)``, has no upper bound. Histograms are merged by adding counts.
    """
    le = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        le = F.when(F.col(value) <= bounds[i], F.lit(i)).otherwise(le)
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys, le.alias("le")).agg(F.count("*").alias("cnt"))


def from_histogram(buckets: DataFrame, keys: list[str], bounds: list[int], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles of merged buckets (keys, le, cnt): linear inside the bucket that holds the rank.

    The lowest bucket begins at 0; a rank in the open bucket gives the greatest bound. A group has
    at most one row per bound in a window.
    """
    merged = buckets.groupBy(*keys, "le").agg(F.sum("cnt").alias("cnt"))
    order = Window.partitionBy(*keys).orderBy("le")
    upto = F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = merged.withColumn("upto", upto).withColumn("n", F.sum("cnt").over(Window.partitionBy(*keys)))
    edges = F.array(*[F.lit(float(b)) for b in [0, *bounds, bounds[-1]]])
    low, high = F.get(edges, F.col("le")), F.get(edges, F.col("le") + 1)
    made = []
    for name, p in probabilities.items():
        rank = F.col("n") * F.lit(float(p))
        before = F.col("upto") - F.col("cnt")
        here = (before < rank) & (rank <= F.col("upto"))
        at = low + (high - low) * (rank - before) / F.col("cnt")
        made.append(F.max(F.when(here, at)).alias(name))
    return rows.groupBy(*keys, "n").agg(*made)
