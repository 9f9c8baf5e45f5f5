"""Stored aggregates kept up to date by deltas: sums, minima and maxima per key.

A delta is a table of partial results; a key may be in many. Readers merge what they read, and
compaction merges the deltas of a crowded partition for good. All parts and their list are ``Parts``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admeter.sources.parts import Entry, Parts, Wanted, everything

HOW = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Summed:
    parts: Parts
    values: dict[str, str]  # column -> sum, min or max

    @property
    def keys(self) -> list[str]:
        return [c for c in self.parts.schema.fieldNames() if c not in self.values]

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.parts.schema.fields])

    def merged(self, rows: DataFrame) -> DataFrame:
        made = [HOW[how](c).alias(c) for c, how in self.values.items()]
        return self._typed(rows.groupBy(*self.keys).agg(*made))

    def add(self, delta: DataFrame, tag: str) -> None:
        """Add one delta, grouped by partition for the writers; the same tag again replaces it."""
        rows = self._typed(delta).hint("rebalance", *self.parts.partitions)
        self.parts.add(rows.sortWithinPartitions(*self.keys), tag)

    def read(self, wanted: Wanted = everything) -> DataFrame:
        """One row per key of the wanted partitions."""
        return self.merged(self.parts.read(wanted))

    def compact(self, most: int, also: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Merge the deltas of partitions in more than ``most`` parts; ``also`` may drop merged rows."""
        old: list[Entry] = self.parts.crowded(most)
        if old:
            rows = self.merged(self.parts.read_entries(old))
            rows = also(rows) if also else rows
            rows = rows.hint("rebalance", *self.parts.partitions).sortWithinPartitions(*self.keys)
            self.parts.replace(old, rows, f"compact-{uuid.uuid4().hex}")
        return len({e["folder"] for e in old})
