"""Batched matrix inversion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements of the matrices that are inverted together.
HELD = 1 << 18


def inverse(m: DataFrame) -> DataFrame:
    """(b, i, k, re, im): the inverse of each square complex matrix m(b, i, k, re, im); none for a singular one.

    Missing elements count as zero; a matrix's order is its largest index plus one. As many matrices as
    have HELD elements make one group and are inverted as one stack, smaller ones with ones on the rest
    of the diagonal.
    """
    rows = m.select(F.col("b").cast("bigint").alias("b"), F.col("i").cast("int").alias("i"), F.col("k").cast("int").alias("k"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    order = (rows.agg(F.max(F.greatest("i", "k"))).first()[0] or 0) + 1
    per = max(1, HELD // (order * order))

    def run(key, table):
        b, i, k = (table[c].to_numpy() for c in ("b", "i", "k"))
        names, at = np.unique(b, return_inverse=True)
        n = np.zeros(len(names), np.int64)
        np.maximum.at(n, at, np.maximum(i, k) + 1)
        size = int(n.max())
        a = np.zeros((len(names), size, size), np.complex128)
        np.add.at(a, (at, i, k), table["re"].to_numpy() + 1j * table["im"].to_numpy())
        rest = np.arange(size)[None, :] >= n[:, None]
        a[:, np.arange(size), np.arange(size)] += rest
        try:
            z, ok = np.linalg.inv(a), np.ones(len(names), bool)
        except np.linalg.LinAlgError:  # one of them is singular: find out which
            z, ok = np.zeros_like(a), np.zeros(len(names), bool)
            for q, one in enumerate(a):
                try:
                    z[q], ok[q] = np.linalg.inv(one), True
                except np.linalg.LinAlgError:
                    continue
        inside = ok[:, None, None] & ~rest[:, :, None] & ~rest[:, None, :]
        q, row, col = np.nonzero(inside)
        z = z[inside]
        return pa.table({"b": pa.array(names[q], pa.int64()), "i": pa.array(row, pa.int32()), "k": pa.array(col, pa.int32()), "re": z.real.copy(), "im": z.imag.copy()})

    return rows.withColumn("_of", F.floor(F.col("b") / per)).groupBy("_of").applyInArrow(run, "b bigint, i int, k int, re double, im double")
