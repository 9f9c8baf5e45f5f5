"""The given ``events`` table as canonical events, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.model import EVENT_COLUMNS, EVENT_SCHEMA
from admeter.operators.ordered import row_number
from admeter.session import prepare
from admeter.sources.shared import delete, new_path

#: Arrival numbers of one span of a partition of the dead-letter log.
SEQ_SPAN = 1 << 20

CANONICAL = """
SELECT
 concat('evt_', CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1
   WHEN event_id % 100 = 98 THEN event_id - 50 ELSE event_id END AS STRING)) AS event_id,
 CASE WHEN event_id % 211 = 0 THEN '' ELSE concat('tenant_', CAST(user_id % 5 AS STRING)) END
   AS tenant_id,
 CASE WHEN event_id % 97 = 0 THEN '   ' ELSE concat('user_', CAST(user_id AS STRING)) END
   AS user_id,
 CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('sess_', CAST(user_id AS STRING)) END
   AS session_id,
 CASE WHEN event_type = 'click' OR (event_type = 'view' AND k % 2 = 0)
   THEN concat('camp_', CAST(k % 8 AS STRING)) END AS campaign_id,
 CASE event_type
   WHEN 'click' THEN CASE WHEN event_id % 7 = 0 THEN ' click ' ELSE 'CLICK' END
   WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'IMPRESSION' ELSE 'PRODUCT_VIEW' END
   WHEN 'signup' THEN 'ADD_TO_CART' WHEN 'purchase' THEN 'PURCHASE' ELSE 'ERROR' END
   AS event_type,
 ts_ms AS event_timestamp_ms,
 value AS cost,
 CAST(NULL AS MAP<STRING, STRING>) AS custom_tags,
 concat('plc_', CAST(k % 4 AS STRING)) AS placement_id,
 CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'IN' ELSE 'BR' END
   AS geo_country,
 CASE event_id % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'web' END AS device_type,
 ts_ms + CASE WHEN event_id % 20 = 7 THEN 600000 ELSE 0 END AS arrival_ms,
 event_id AS seq,
 CAST(user_id % 4 AS INT) AS source_partition,
 k
FROM (
  SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
    unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms
  FROM {events})
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events plus ``source_partition`` and the raw number ``k``."""
    return spark.sql(CANONICAL, events=read_table(spark, sf_dir, "events"))


def arrival_stream(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The same events as a stream in the order of arrival, ``parts`` micro-batches of about equal size.

    The table is written anew in ranges of ``arrival_ms``; a trigger takes the files of one range, which are
    as many for every range (a file without rows where one is missing) and enough for all cores. The given
    table is read once to find the ranges and once to deal its rows to them, however many ranges there are.
    """
    events = canonical(spark, sf_dir).select(*EVENT_COLUMNS)
    shares = [i / parts for i in range(1, parts)]
    cuts = events.agg(F.percentile_approx("arrival_ms", shares, 10_000)).first()[0] if shares else []
    files = max(spark.sparkContext.defaultParallelism, len(events.inputFiles()) // parts)
    path, dealt = new_path(spark, "arrivals"), new_path(spark, "dealt")
    cuts = sorted(set(cuts or []))
    at = F.coalesce("arrival_ms", "event_timestamp_ms", F.lit(0))
    range_no = sum((F.when(at > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    events.withColumn("range_no", range_no).write.partitionBy("range_no").parquet(dealt)
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("range_no", T.IntegerType())])
    ranges = spark.read.schema(schema).parquet(dealt)
    due = 0
    for n in range(len(cuts) + 1):
        rows = ranges.where(F.col("range_no") == n).drop("range_no")
        rows.repartition(files).write.mode("append").parquet(path)
        due += files
        for _ in range(due - len(spark.read.schema(EVENT_SCHEMA).parquet(path).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    delete(spark, dealt)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def dead_letters(rejected: DataFrame) -> DataFrame:
    """Rejected events as a partitioned log: (partition, offset) by arrival number."""
    log = rejected.withColumnRenamed("source_partition", "partition")
    numbered = row_number(log, ["partition"], ["seq"], "_n", SEQ_SPAN)
    return numbered.withColumn("offset", numbered["_n"] - 1).drop("_n")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product views read as requests to the query side."""
    return canonical(spark, sf_dir).where("event_type = 'PRODUCT_VIEW'").selectExpr(
        "seq",
        "tenant_id",
        "concat('camp_', CAST(k % 8 AS STRING)) AS campaign_id",
        "CASE k % 3 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'IMPRESSION' ELSE 'CLICK_TO_BASKET' END"
        " AS metric",
        "event_timestamp_ms AS from_ms",
        "event_timestamp_ms AS ts_ms",
        "seq % 5 <> 0 AS cache_hit",
    )

