"""Tables that a stream writes, one folder per micro-batch.

A micro-batch that runs again after a failure overwrites its own folder, so every table holds
each batch once although the batch function itself may run more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", 500_000).parquet(
        f"{path}/batch={batch_id}"
    )


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches, with the column ``batch``."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).option("basePath", path).parquet(path)
