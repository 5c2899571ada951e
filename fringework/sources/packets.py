"""Binary voltage payloads and flat index layouts to coordinates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fringework.sources import ranges

#: Axes from the slowest to the fastest in each layout, and bytes of a packet where it has them.
LAYOUTS = {
    "dsa110": ("t_outer", "ant", "chan", "t_inner", "pol"),
    "casm": ("t_outer", "ant", "chan", "t_inner", "pol"),
    "gemm": ("chan", "pol", "t_inner", "k", "ant"),
    "tcc": ("t", "ant", "chan", "pol"),
    "qc": ("chan", "pol", "ant", "t"),
    "herk": ("batch", "ant", "k"),
}
PACKET = {"dsa110": 4608, "casm": 46080, "gemm": 8192}


def coordinates(index: Column, layout: str | Sequence[str], sizes: dict[str, int]) -> dict[str, Column]:
    """A column for each axis of a flat index; the slowest axis needs no size."""
    axes = LAYOUTS[layout] if isinstance(layout, str) else tuple(layout)
    out, step = {}, 1
    for k, a in reversed(list(enumerate(axes))):
        at = F.floor(index / step).cast("bigint")
        out[a] = at % sizes[a] if k else at
        step *= sizes.get(a, 1)
    return {a: out[a] for a in axes}


def flat_index(layout: str | Sequence[str], sizes: dict[str, int]) -> Column:
    """The inverse: a flat index from the axes' columns."""
    axes = LAYOUTS[layout] if isinstance(layout, str) else tuple(layout)
    out = F.col(axes[0]).cast("bigint")
    for a in axes[1:]:
        out = out * sizes[a] + F.col(a)
    return out


def read(spark: SparkSession, path: str, layout: str, sizes: dict[str, int], chunk: int = 1 << 20) -> DataFrame:
    """(payload, index, byte, axes): every byte of the files below path, a file being a payload.

    A file is read in ranges by as many tasks as its size asks for. Its size must be whole packets.
    """
    packet = PACKET.get(layout)

    def run(batches):
        for name, at, length, data in ranges.contents(batches):
            if packet and length % packet:
                raise ValueError(f"{name}: {length} bytes are no whole number of {packet}-byte packets")
            raw = np.frombuffer(data, np.uint8)
            for k in range(0, len(raw), chunk):
                part = raw[k : k + chunk]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at + k, at + k + len(part))), pa.array(part.astype(np.int16))], ["payload", "index", "byte"])

    rows = ranges.planned(ranges.files(spark, path)).mapInArrow(run, "payload string, index bigint, byte smallint")
    return rows.select("*", *[c.alias(a) for a, c in coordinates(F.col("index"), layout, sizes).items()])


def random_voltage(spark: SparkSession, n: int, layout: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """n bytes that look random, the same in every run and engine: a linear congruence of the index."""
    rows = spark.range(n).select(F.col("id").alias("index"), F.expr(f"cast(((id * 1103515245 + {seed} * 12345) % 2147483648) div 65536 % 256 as int)").alias("byte"))
    return rows.select("*", *[c.alias(a) for a, c in coordinates(F.col("index"), layout, sizes).items()])


def noise(spark: SparkSession, n: int, mean: float = 0.0, sigma: float = 1.0, seed: int = 42) -> DataFrame:
    """(index, value): normal noise from Spark's own generator."""
    return spark.range(n).select(F.col("id").alias("index"), (F.randn(seed) * sigma + mean).alias("value"))
