"""Products over a shared axis by tiles: bounded dense pieces that meet in one task and are multiplied as matrices.

A relational product makes a row for each element of both sides that meet; here a pair of tiles makes
one dense product instead. Rows, columns and the inner axis are dealt out by hash, so no axis needs to
be dense, and each side is sent out as often as the other one has tiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements along an edge of a tile, about; a tile of complex numbers has 16 bytes for each.
TILE = 512
WHOLE = ("tinyint", "smallint", "int", "bigint")


def places(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """For each row its number among the different values of the named columns, and those values as columns."""
    frame = table.select(list(names)).to_pandas()
    code = frame.groupby(list(names), sort=True, dropna=False).ngroup().to_numpy()
    first = np.unique(code, return_index=True)[1]
    return code, [table[n].combine_chunks().take(pa.array(first)) for n in names]


def dense(table: pa.Table, row: np.ndarray, col: np.ndarray, shape: tuple[int, int], re: str, im: str) -> np.ndarray:
    out = np.zeros(shape, np.complex128)
    np.add.at(out, (row, col), table[re].to_numpy().astype(float) + 1j * table[im].to_numpy().astype(float))
    return out


def parted(values: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary part; rounded to whole numbers where all inputs were (exact up to 2^53)."""
    return (np.rint(values.real).astype(np.int64), np.rint(values.imag).astype(np.int64)) if whole else (values.real.copy(), values.imag.copy())


def product(x: DataFrame, y: DataFrame, on: Sequence[str], rows: Sequence[str], inner: str, cols: Sequence[str], tile: int = TILE) -> DataFrame:
    """(on, rows, cols, re, im): the sum over inner of x(on, rows, inner, ar, ai) times y(on, inner, cols, br, bi).

    What is missing counts as zero; a row and column that share no inner element may come out as zero.
    """
    on, rows, cols = list(on), list(rows), list(cols)
    kinds = dict(x.dtypes) | dict(y.dtypes)
    whole = all(kinds[c] in WHOLE for c in ("ar", "ai", "br", "bi"))

    def most(d: DataFrame, *axes: list[str]) -> list[int]:
        n = d.groupBy(*on).agg(*[F.approx_count_distinct(F.struct(*a)).alias(f"n{k}") for k, a in enumerate(axes)])
        got = n.agg(*[F.max(f"n{k}") for k in range(len(axes))]).first()
        return [max(1, math.ceil((v or 1) / tile)) for v in got]

    (n_row, n_inner), (n_col,) = most(x, rows, [inner]), most(y, cols)
    part = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.select(*on, *rows, inner, "ar", "ai", part(rows, n_row).alias("_r"), part([inner], n_inner).alias("_k"), every(n_col).alias("_c"))
    y = y.select(*on, inner, *cols, "br", "bi", part(cols, n_col).alias("_c"), part([inner], n_inner).alias("_k"), every(n_row).alias("_r"))
    names = [*on, *rows, *cols]
    number = "bigint" if whole else "double"
    types = [x.schema[c].dataType if c in x.columns else y.schema[c].dataType for c in names]
    form = ", ".join(f"`{c}` {t.simpleString()}" for c, t in zip(names, types)) + f", re {number}, im {number}"

    def multiply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            empty = [(left if c in left.column_names else right).schema.field(c).type for c in names]
            return pa.table([pa.array([], t) for t in [*empty, pa.int64() if whole else pa.float64()] + [pa.int64() if whole else pa.float64()]], names=[*names, "re", "im"])
        r, row_values = places(left, rows)
        c, col_values = places(right, cols)
        k = np.unique(np.concatenate((left[inner].to_numpy(), right[inner].to_numpy())), return_inverse=True)[1]
        n_k = int(k.max()) + 1
        a = dense(left, r, k[: len(r)], (int(r.max()) + 1, n_k), "ar", "ai")
        b = dense(right, k[len(r) :], c, (n_k, int(c.max()) + 1), "br", "bi")
        z = a @ b
        i, j = (v.ravel() for v in np.indices(z.shape))
        keys = [pa.array([v.as_py()] * z.size, left.schema.field(c).type) for c, v in zip(on, key)]
        re, im = parted(z.ravel(), whole)
        return pa.table([*keys, *[v.take(pa.array(i)) for v in row_values], *[v.take(pa.array(j)) for v in col_values], pa.array(re), pa.array(im)], names=[*names, "re", "im"])

    by = [*on, "_r", "_k", "_c"]
    done = x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(multiply, form)
    return done.groupBy(*names).agg(F.sum("re").alias("re"), F.sum("im").alias("im")) if n_inner > 1 else done
