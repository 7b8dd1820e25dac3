"""Tables written between the steps of a loop."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder in spark.checkpoint.dir (a temporary one where it is unset); what is there goes when the JVM ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        made = tempfile.mkdtemp(prefix="turnwise-steps-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        folder = spark.sparkContext.getCheckpointDir()
    where = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def step(df: DataFrame, label: str) -> DataFrame:
    """Write a step's result to the shared folder and read it back."""
    where = scratch(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by a key to as many tasks as a shuffle has, however small they are: for what costs much a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
