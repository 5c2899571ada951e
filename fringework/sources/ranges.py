"""Files read by ranges, so that one large file is many tasks' work; on file systems that Arrow opens by URI (local, HDFS, S3, GCS)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a range, about.
STEP = 32 << 20
SCHEMA = "path string, at bigint, size bigint, length bigint"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below path; nothing of their content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def opened(path: str):
    system, inside = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return system.open_input_file(inside)


def planned(found: DataFrame, step: int = STEP) -> DataFrame:
    """(path, at, size, length): the ranges of files(path, length), dealt out evenly. An empty file has none."""
    starts = F.explode(F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint"))))
    rows = found.select("path", "length", starts.alias("at"))
    rows = rows.select("path", "at", F.least(F.lit(step), F.col("length") - F.col("at")).cast("bigint").alias("size"), "length")
    n = found.agg(F.sum(F.ceil(F.col("length") / step))).first()[0] or 1
    return rows.repartition(max(1, math.ceil(n)), "path", "at")


def contents(batches) -> Iterator[tuple[str, int, int, pa.Buffer]]:
    """(path, at, length, bytes) of planned ranges; the file read last stays open."""
    file, held = None, None
    for batch in batches:
        for path, at, size, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if path != held:
                if file is not None:
                    file.close()
                file, held = opened(path), path
            data = file.read_at(size, at)
            if len(data) != size:
                raise ValueError(f"{path} ends before {at + size}")
            yield path, at, length, pa.py_buffer(data)
    if file is not None:
        file.close()
