"""Triangles, full matrices and block forms. Where axes are columns, most layouts are a select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fringework.functions import axes


def with_lower_index(tri: DataFrame) -> DataFrame:
    return tri.withColumn("bl", axes.lower_index(F.col("ant_i"), F.col("ant_j")))


def full(tri: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A lower triangle to the whole Hermitian matrix: the mirror image is the conjugate, the diagonal real."""
    lower = tri.select(*keys, "ant_i", "ant_j", "re", F.when(F.col("ant_i") == F.col("ant_j"), F.col("im") * 0).otherwise(F.col("im")).alias("im"))
    upper = tri.where("ant_i <> ant_j").select(*keys, F.col("ant_j").alias("ant_i"), F.col("ant_i").alias("ant_j"), "re", (-F.col("im")).alias("im"))
    return lower.unionByName(upper)


def transposed(matrix: DataFrame) -> DataFrame:
    """The matrix for which element (i, j) is conj(A_i) A_j instead of A_i conj(A_j)."""
    return matrix.withColumn("im", -F.col("im"))


def lower(matrix: DataFrame) -> DataFrame:
    return matrix.where("ant_j <= ant_i")


def upper(matrix: DataFrame, n: int) -> DataFrame:
    """The upper triangle with its packed index tri."""
    return matrix.where("ant_j >= ant_i").withColumn("tri", axes.upper_index(F.col("ant_i"), F.col("ant_j"), n))


def antisymmetric(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(m - transpose of m) / 2."""
    t = matrix.select(*keys, F.col("ant_j").alias("ant_i"), F.col("ant_i").alias("ant_j"), (-F.col("re")).alias("re"), (-F.col("im")).alias("im"))
    return matrix.select(*keys, "ant_i", "ant_j", "re", "im").unionByName(t).groupBy(*keys, "ant_i", "ant_j").agg((F.sum("re") / 2).alias("re"), (F.sum("im") / 2).alias("im"))


def corner_turn(beams: DataFrame, value: str = "power") -> DataFrame:
    """(beam, chan, samples): each series as an array in order of t. For sinks that want blocks."""
    return beams.groupBy("beam", "chan").agg(F.array_sort(F.collect_list(F.struct("t", value))).alias("s")).select("beam", "chan", F.col(f"s.{value}").alias("samples"))


def unfold(blocks: DataFrame, value: str = "power") -> DataFrame:
    """The inverse of corner_turn()."""
    return blocks.select("beam", "chan", F.posexplode("samples").alias("t", value))


def interleave(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, part, value): real parts as part 0, imaginary ones as part 1."""
    return m.select(*keys, F.posexplode(F.array("re", "im")).alias("part", "value"))


def deinterleave(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    part = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
    return m.groupBy(*keys).agg(part(0).alias("re"), part(1).alias("im"))


def inspect(m: DataFrame, index: str, low: int, high: int) -> DataFrame:
    """Elements with low <= index < high."""
    return m.where((F.col(index) >= low) & (F.col(index) < high))


def fold_baselines(vis: DataFrame, lookup: DataFrame, times: int = 2, channels: int = 4) -> DataFrame:
    """(out, chan, t, re, im): baselines renamed by lookup(bl, out), summed over ``times`` times and ``channels`` channels."""
    rows = vis.join(lookup, "bl").select("out", F.floor(F.col("chan") / channels).cast("int").alias("chan"), F.floor(F.col("t") / times).cast("bigint").alias("t"), "re", "im")
    return rows.groupBy("out", "chan", "t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
