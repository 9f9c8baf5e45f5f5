"""Tables written between two steps of a job, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session may do without the setting."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="admeter-")
    spark.conf.set(SETTING, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Later steps see fixed rows even when executors are lost and tasks run again, and
    columns that a later step does not use are not read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def file_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Length and modification time of a file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
    return status.getLen(), status.getModificationTime()
