"""Groups of rows in tasks of bounded size: large groups are cut into chunks that meet in pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeter.llm.common import merge_settings, partitions

Group = dict[str, np.ndarray]


def tiled(rows: DataFrame, group: str, member: str, size: int, weight: str | None = None, room: int = 0) -> DataFrame:
    """Adds ``tile`` to rows so that any two members of a group share a tile.

    A group of at most ``size`` rows (and ``room`` weight) is one tile. A larger one is cut into
    chunks by a hash of the member, and each pair of chunks is a tile.
    """
    total = [F.count("*").alias("__n")] + ([F.sum(weight).alias("__w")] if weight else [])
    need = F.ceil(F.col("__n") / size)
    if weight:
        need = F.greatest(need, F.ceil(F.col("__w") / room))
    # chunks of half a tile, as two of them meet
    chunks = F.when(need > 1, 2 * need).otherwise(1).cast("int")
    counts = rows.groupBy(group).agg(*total).select(group, chunks.alias("__c"))
    rows = rows.join(counts.where("__c > 1"), group, "left").withColumn("__c", F.coalesce("__c", F.lit(1)))
    mine = F.pmod(F.xxhash64(member, F.lit("tile")), F.col("__c")).cast("int")
    rows = rows.withColumn("__m", mine)
    other = F.explode(
        F.when(F.col("__c") == 1, F.array(F.lit(0))).otherwise(
            F.filter(F.sequence(F.lit(0), F.col("__c") - 1), lambda k: k != F.col("__m"))
        )
    )
    rows = rows.withColumn("__o", other)
    low, high = F.least("__m", "__o"), F.greatest("__m", "__o")
    return rows.withColumn("tile", low.cast("long") * 1_000_000 + high).drop("__c", "__m", "__o")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[Group]:
    """Rows of equal keys, from batches that are sorted by them."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        change = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        for a, b in zip(starts, starts[1:], strict=False):
            yield {c: v[a:b] for c, v in columns.items()}
        held = pdf.iloc[starts[-1] :]
    if held is not None:
        yield {c: held[c].to_numpy() for c in held.columns}


def connected(near: np.ndarray) -> np.ndarray:
    """The least index each row of a symmetric matrix of links reaches."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        least = np.where(near, label, len(near)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def linked(
    rows: DataFrame, keys: list[str], near: Callable[[Group], np.ndarray]
) -> DataFrame:
    """(a, b): a forest over ``id`` that connects what ``near`` links within each group.

    ``near`` gets one group (arrays by column) and returns its matrix of links. Nothing but
    the forest leaves a task, at most one link per row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for g in runs(batches, keys):
            if len(g["id"]) > 1:
                root = connected(near(g))
                low = np.flatnonzero(root != np.arange(len(root)))
                a.append(g["id"][low])
                b.append(g["id"][root[low]])
            if len(a) >= 4096:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInPandas(run, "a long, b long")


def held_batches(df: DataFrame, batch: int):
    """Session option that keeps Arrow batches of wide rows small."""
    return merge_settings(df.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)})
