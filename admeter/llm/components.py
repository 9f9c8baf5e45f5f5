"""Connected components of a link table by alternating large and small stars.

Each step connects every node's larger neighbours, then its smaller ones, to the smallest node it
sees; the tables shrink to one star per component. A step is written to the shared folder, so
lineage stays short; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeter.sources.shared import delete, new_path


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _step(e: DataFrame) -> tuple[DataFrame, list[str]]:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    least, one = _written(least, "cc-least")
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large, two = _written(large.distinct(), "cc-large")
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    low, three = _written(low, "cc-low")
    small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), [one, two, three]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link to another.

    Links may repeat and point either way; nulls and links to oneself count for nothing.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = links.where(x.isNotNull() & y.isNotNull() & (x != y))
    e = e.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    e, path = _written(e, "cc")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = mark
        following, scratch = _step(e)
        following, next_path = _written(following, "cc")
        for p in (*scratch, path):
            delete(e.sparkSession, p)
        e, path = following, next_path
