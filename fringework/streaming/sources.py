"""Streams over tables that are there, and what a finished stream has written."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def work_folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir, or /tmp on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def of_table(spark: SparkSession, sf_dir: str, name: str, files: int = 4) -> DataFrame:
    """A table's files as a stream, a few in each micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parquet*")


def finished(spark: SparkSession, query: StreamingQuery, path: str, schema: T.StructType) -> DataFrame:
    """Waits until the stream has come to its end; then what it wrote."""
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
