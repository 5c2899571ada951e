"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_folders: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; it goes when the driver ends.

    What a result still reads can't go earlier, since results are lazy; release() takes all folders at
    once. Where the setting is absent, /tmp/checkpoints stands in for it, on a local master only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/fringework-{uuid.uuid4().hex}"
    path, system = _hadoop(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    _folders.append(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Deletes every folder that shared_dir() has given; results that have not been written down can't be read any more."""
    while _folders:
        drop_dir(spark, _folders.pop())


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes what stored() wrote, through Hadoop's file system API."""
    p, system = _hadoop(spark, path)
    system.delete(p, True)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
