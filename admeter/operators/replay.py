"""Replay of the dead-letter log that goes on where it stopped.

What a replay has read is stored as a part under its id; the cursor is the largest offset among all
stored parts. So output and cursor are one atomic commit: a replay that died before it changed
nothing, and one that is done again after it does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.config import Settings
from admeter.model import EVENT_SCHEMA
from admeter.operators import dead_letter
from admeter.sources.parts import Parts

POLLED = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField("key", T.StringType()),
        T.StructField("dlq_reason", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("replayed", T.BooleanType()),
        T.StructField("rejected_again", T.BooleanType()),
        T.StructField("partition", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class ReplayStore:
    spark: SparkSession
    path: str

    @property
    def _parts(self) -> Parts:
        return Parts(self.spark, self.path, ("partition",), POLLED)

    def cursor(self) -> DataFrame:
        """partition, next_offset."""
        return dead_letter.next_offsets(self._parts.read())

    def run(
        self, log: DataFrame, replay_id: str, settings: Settings, tenant: str | None = None, reason: str | None = None, requested: int = 0
    ) -> DataFrame:
        """The records that this replay read, each replayed or skipped."""
        if not any(e["tag"] == replay_id for e in self._parts.live()):
            polled = dead_letter.polled(log, settings, tenant, reason, requested, self.cursor())
            self._parts.add(polled.select(*[F.col(f.name).cast(f.dataType) for f in POLLED.fields]), replay_id)
        return self.of(replay_id)

    def of(self, replay_id: str) -> DataFrame:
        return self._parts.read_entries([e for e in self._parts.live() if e["tag"] == replay_id])

    def everything(self) -> DataFrame:
        return self._parts.read()
