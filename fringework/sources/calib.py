"""Calibration and flag files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _floats(spark: SparkSession, path: str, n_ant: int, n_fq: int, schema: str, take) -> DataFrame:
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.frombuffer(data, "<f4").astype(float)
                if len(x) != n_ant * (2 + 4 * n_fq):
                    raise ValueError(f"{len(x)} numbers instead of {n_ant * (2 + 4 * n_fq)}")
                yield take(x)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def antennas(spark: SparkSession, path: str, n_ant: int, n_fq: int) -> DataFrame:
    """(ant, e, n): a calibration file's first numbers are all e, then all n."""
    take = lambda x: pa.RecordBatch.from_arrays([pa.array(np.arange(n_ant), pa.int32()), pa.array(x[:n_ant]), pa.array(x[n_ant : 2 * n_ant])], ["ant", "e", "n"])
    return _floats(spark, path, n_ant, n_fq, "ant int, e double, n double", take)


def calibration(spark: SparkSession, path: str, n_ant: int, n_fq: int) -> DataFrame:
    """(ant, fq, pol, re, im): after the places come antenna, frequency, polarisation and the two parts."""

    def take(x):
        c = x[2 * n_ant :].reshape(-1, 2)
        rest, pol = np.divmod(np.arange(len(c)), 2)
        ant, fq = np.divmod(rest, n_fq)
        return pa.RecordBatch.from_arrays([pa.array(ant, pa.int32()), pa.array(fq, pa.int32()), pa.array(pol, pa.int32()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], ["ant", "fq", "pol", "re", "im"])

    return _floats(spark, path, n_ant, n_fq, "ant int, fq int, pol int, re double, im double", take)


def flags(spark: SparkSession, path: str) -> DataFrame:
    """(ant): one number on each line; lines that hold none are left out."""
    return spark.read.schema("ant INT").csv(path).where("ant is not null").distinct()
