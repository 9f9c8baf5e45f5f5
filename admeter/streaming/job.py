"""The end-to-end stream: raw events in; unique events, conversions, counters, lake, dead letters out.

    raw -> valid -> de-duplicated -> unique
     |  |                              |-> attributed -> conversions
     |  |-> rejected -> dead           |            |
     |-> late                          `------------`-> counters, lake
     `-> unreadable

Each arrow to a table is a streaming query of its own; tables are written by Spark's file sink, whose
log gives every row once, and are the sources of the queries after them. All state is Spark's (RocksDB):
session windows, windows, one interval join. Rows that the watermark would lose (too late, dated
ahead) are told apart before it by a rule without state and go to ``late``.

Set ``spark.sql.shuffle.partitions`` before the first start: the number of state partitions is
fixed for the life of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from admeter.config import Settings
from admeter.model import EVENT_COLUMNS, EVENT_SCHEMA
from admeter.plans import ingest as plans
from admeter.sources import lake
from admeter.streaming import counters
from admeter.streaming.attribution import conversions
from admeter.streaming.clock import UNTIL_STOPPED, closable, late, punctual, run_to_end, timed
from admeter.streaming.dedup import unique

DEAD_SCHEMA = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField("key", T.StringType()),
        T.StructField("dlq_reason", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Folders:
    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"

    def closing(self, name: str) -> str:
        return f"{self.root}/closing/{name}"


#: Turns source records into (events, unreadable records).
Decoder = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _writer(stream: DataFrame, name: str, out: Folders, trigger: dict):
    return (
        stream.writeStream.queryName(f"{name}-{out.root.rsplit('/', 1)[-1]}")
        .option("checkpointLocation", out.checkpoint(name))
        .trigger(**trigger)
    )


def _to_table(stream: DataFrame, name: str, out: Folders, trigger: dict) -> StreamingQuery:
    """A table of the stream's rows, each once (the file sink keeps a log of what it committed)."""
    return _writer(stream, name, out, trigger).format("parquet").option("path", f"{out.root}/{name}").start()


def _table_stream(spark: SparkSession, out: Folders, name: str, schema: T.StructType, files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{out.root}/{name}")


def start_unique(raw: DataFrame, out: Folders, settings: Settings, trigger: dict) -> StreamingQuery:
    valid = plans.valid(punctual(raw, settings)).select(*EVENT_COLUMNS)
    events = timed(closable(valid, out.closing("unique")), settings.stream_lateness_ms)
    return _to_table(unique(events, settings), "unique", out, trigger)


def start_conversions(
    spark: SparkSession, out: Folders, settings: Settings, trigger: dict, files: int | None = None
) -> StreamingQuery:
    """Attribution over the unique events, ``files`` of their table a trigger.

    These come out when their id is closed: a TTL and the lateness after its last copy. An id with
    several kept rows brings its first one later, by the span of its copies.
    """
    events = _table_stream(spark, out, "unique", EVENT_SCHEMA, files)
    delay = settings.stream_lateness_ms + settings.span_ms
    return _to_table(
        conversions(timed(closable(events, out.closing("conversions")), delay), settings), "conversions", out, trigger
    )


def start_sinks(spark: SparkSession, out: Folders, trigger: dict) -> list[StreamingQuery]:
    """Counters and lake from both tables; a micro-batch that runs again replaces what it wrote."""

    def each(name: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.persist(StorageLevel.MEMORY_AND_DISK)
            counters.add_deltas(batch, f"{out.counters}/{name}", batch_id)
            lake.append(batch, out.lake, f"{name}-{batch_id}")
            batch.unpersist()

        return write

    return [
        _writer(_table_stream(spark, out, name, EVENT_SCHEMA, None), f"sinks-{name}", out, trigger)
        .foreachBatch(each(name))
        .start()
        for name in ("unique", "conversions")
    ]


def start_sides(raw: DataFrame, out: Folders, settings: Settings, trigger: dict) -> list[StreamingQuery]:
    dead = plans.rejected(raw).select(*DEAD_SCHEMA.fieldNames())
    behind = late(plans.valid(raw).select(*EVENT_COLUMNS), settings)
    return [_to_table(dead, "dead", out, trigger), _to_table(behind, "late", out, trigger)]


def start(raw: DataFrame, out: Folders, settings: Settings, trigger: dict, decode: Decoder | None = None) -> list[StreamingQuery]:
    """Start the whole job; ``decode`` turns source records into events."""
    started = []
    if decode is not None:
        raw, bad = decode(raw)
        started.append(_to_table(bad, "unreadable", out, trigger))
    spark = raw.sparkSession
    return [
        *started,
        start_unique(raw, out, settings, trigger),
        *start_sides(raw, out, settings, trigger),
        start_conversions(spark, out, settings, trigger),
        *start_sinks(spark, out, trigger),
    ]


def run_available(
    raw: DataFrame,
    out: Folders,
    settings: Settings,
    ends: bool = False,
    decode: Decoder | None = None,
    files: int | None = None,
) -> dict:
    """Process everything that is there, then stop; a later call goes on from the checkpoints.

    With ``ends`` nothing will follow: windows still open are closed and come out too. Returns the
    progress of the stateful queries.
    """
    spark, once, progress = raw.sparkSession, {"availableNow": True}, {"unique": [], "conversions": []}
    stateful = UNTIL_STOPPED if ends else once

    def finish(*queries: StreamingQuery) -> None:
        for q in queries:
            name = q.name.split("-")[0]
            if ends and name in progress:
                run_to_end(spark, q, out.closing(name))
            else:
                q.awaitTermination()
            if name in progress:
                progress[name] += q.recentProgress

    if decode is not None:
        raw, bad = decode(raw)
        finish(_to_table(bad, "unreadable", out, once))
    finish(start_unique(raw, out, settings, stateful), *start_sides(raw, out, settings, once))
    finish(start_conversions(spark, out, settings, stateful, files))
    finish(*start_sinks(spark, out, once))
    return progress


def enriched(spark: SparkSession, out: Folders) -> DataFrame:
    """Unique events and conversions written so far."""
    tables = [spark.read.schema(EVENT_SCHEMA).parquet(f"{out.root}/{name}") for name in ("unique", "conversions")]
    return tables[0].unionByName(tables[1])


def late_rows(spark: SparkSession, out: Folders) -> DataFrame:
    """Valid rows that the streams did not wait for; ``lake.upsert_late`` takes them in."""
    return spark.read.schema(EVENT_SCHEMA).parquet(out.late)


def dead_letters(spark: SparkSession, out: Folders) -> DataFrame:
    return spark.read.schema(DEAD_SCHEMA).parquet(out.dead)
