"""Kafka sources and sinks and the wire formats.

The Kafka package is not part of a plain Spark install. Everything here only builds DataFrames, so
sources and sinks fail at the first use without it; both wire formats need no package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.functions import events as E
from admeter.model import EVENT_SCHEMA, WIRE_FIELDS, WIRE_SCHEMA
from admeter.sources import avro_wire


def raw_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 5_000_000):
    """Raw topic as a stream: offsets live in the checkpoint, the first start is at earliest."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )


def whole_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All records of a topic as a batch, with headers (dead-letter replay)."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", "latest")
        .option("includeHeaders", "true")
        .load()
    )


def _from_wire(record: Column) -> list[Column]:
    columns = {column: record[wire] for wire, column in WIRE_FIELDS.items()}
    tags = columns["custom_tags"]
    columns["custom_tags"] = F.when(F.size(tags) > 0, tags)
    return [
        columns.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
        for f in EVENT_SCHEMA.fields
        if f.name not in ("arrival_ms", "seq")
    ]


PARTITION_BITS = 16


def _with_arrival(rows: DataFrame) -> list[Column]:
    """Kafka gives arrival time and order; other sources leave them empty.

    ``seq`` is the offset with the partition in its low bits: unique, and in offset order
    within a partition.
    """
    names = rows.columns
    arrival = F.unix_millis("timestamp") if "timestamp" in names else F.lit(None).cast("bigint")
    seq = F.lit(None).cast("bigint")
    if {"offset", "partition"} <= set(names):
        seq = F.shiftleft(F.col("offset"), PARTITION_BITS) + F.col("partition")
    return [arrival.alias("arrival_ms"), seq.cast("bigint").alias("seq")]


def decode_avro(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry-framed Avro in ``value``: (events, unreadable payloads for the dead-letter table).

    Empty payloads are skipped, empty tags become null. Works without Spark's Avro package.
    """
    filled = rows.where(F.length("value") > 0).withColumn("_r", avro_wire.decode_column(F.col("value")))
    good = filled.where("_r.readable").select(*_from_wire(F.col("_r")), *_with_arrival(rows))
    bad = filled.where("NOT _r.readable").select(
        F.base64("value").alias("payload"), F.lit("Unreadable payload").alias("dlq_reason")
    )
    return good, bad


def decode_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON text in ``value``: (events, unreadable payloads for the dead-letter table)."""
    filled = rows.where(F.length("value") > 0)
    text = F.col("value").cast("string")
    parsed = filled.withColumn("_r", F.from_json(text, WIRE_SCHEMA))
    # PERMISSIVE parsing gives a record of nulls for text that is no such object.
    readable = F.col("_r").isNotNull() & (
        F.col("_r.eventId").isNotNull() | F.col("_r.eventType").isNotNull()
    )
    good = parsed.where(readable).select(*_from_wire(F.col("_r")), *_with_arrival(rows))
    bad = parsed.where(~readable).select(
        text.alias("payload"), F.lit("Unreadable payload").alias("dlq_reason")
    )
    return good, bad


def _wire_struct() -> Column:
    made = []
    for wire, column in WIRE_FIELDS.items():
        c = F.col(column)
        if column == "custom_tags":
            c = F.coalesce(c, F.create_map().cast("map<string,string>"))
        made.append(c.alias(wire))
    return F.struct(*made)


def encode_json(events: DataFrame, key: Column) -> DataFrame:
    """(key, value) records; null tags are sent as the empty map."""
    return events.select(key.alias("key"), F.to_json(_wire_struct()).alias("value"))


def encode_avro(events: DataFrame, key: Column, schema_id: int) -> DataFrame:
    """(key, value) records in the registry frame."""
    return avro_wire.encode_rows(events.select(key.alias("key"), F.inline(F.array(_wire_struct()))), schema_id)


def decode_dead_letters(records: DataFrame) -> DataFrame:
    """Dead-letter records (key, value, headers, partition, offset) as rows of the dead-letter log."""
    reason = F.get(F.filter("headers", lambda h: h["key"] == "dlq-reason"), F.lit(0))["value"].cast("string")
    parsed = records.withColumn("_r", F.from_json(F.col("value").cast("string"), WIRE_SCHEMA))
    return parsed.select(
        *_from_wire(F.col("_r")), *_with_arrival(records), F.col("key").cast("string").alias("key"),
        reason.alias("dlq_reason"), "partition", "offset",
    )


def publish(records: DataFrame, servers: str, topic: str) -> None:
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.compression.type", "lz4")
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("topic", topic)
        .save()
    )


def raw_records(events: DataFrame) -> DataFrame:
    return encode_json(events, E.raw_key())


def enriched_records(events: DataFrame) -> DataFrame:
    return encode_json(events, E.enriched_key())


def dead_letter_records(rejected: DataFrame, position: list[str] = []) -> DataFrame:
    """Redacted events keyed by tenant with the reason as a header (and their ``position`` in a log)."""
    reason = F.array(
        F.struct(F.lit("dlq-reason").alias("key"), F.col("dlq_reason").cast("binary").alias("value"))
    )
    with_reason = rejected.select(E.dlq_key().alias("key"), "*") if "key" not in rejected.columns else rejected
    return with_reason.select("key", F.to_json(_wire_struct()).alias("value"), reason.alias("headers"), *position)


