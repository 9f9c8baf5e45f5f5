"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.sources.shared import delete, new_path

#: A word: a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Columns of the documents table.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(k: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``k``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def boundaries(df: DataFrame, key: str, n: int) -> list:
    """At most ``n`` - 1 values that cut ``key`` into ranges of about as many rows."""
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 10 * n)).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_of(key: str, bounds: list) -> Column:
    """Number of the range a value falls in; equal values and nulls (0) share one."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.size(F.filter(cuts, lambda b: b <= F.col(key))), F.lit(0))


def merge_settings(spark: SparkSession, **conf: str):
    """Set session options for the work inside a ``with`` block."""
    @contextmanager
    def held():
        before = {k: spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return held()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``keep`` for tables that nothing reads after the ``with`` block; they are deleted there."""
    paths = []

    def held(df: DataFrame, name: str) -> DataFrame:
        paths.append(new_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    yield held
    for path in paths:
        delete(spark, path)
