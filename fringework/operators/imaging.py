"""Visibilities to a grid, an image, and beam intensities."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fringework.functions import axes, bits

#: Pixels up to which the Fourier sum is taken, and pixels that a cell meets at once.
FEW_PIXELS, PIXELS_MET = 2048, 256


def cells(baselines: DataFrame, freqs: DataFrame, size: float, n: int) -> DataFrame:
    """(chan, ant_i, ant_j, iu, iv, ju, jv): a baseline's cell and that of its mirror image in each channel.

    baselines has a row for each pair, freqs (chan, hz) a row for each channel; the product is theirs by
    definition and is sent out by channel: every number from the least to the greatest channel meets freqs.
    """
    ends = freqs.agg(F.min("chan").alias("a"), F.max("chan").alias("b")).first()
    every = F.array().cast(f"array<{dict(freqs.dtypes)['chan']}>") if ends.a is None else F.sequence(F.lit(ends.a), F.lit(ends.b))
    rows = baselines.withColumn("chan", F.explode(every)).join(freqs, "chan")
    at = lambda c, s: axes.cell(s * F.col(c), F.col("hz"), size, n)
    return rows.select("chan", "ant_i", "ant_j", at("u_m", 1).alias("iu"), at("v_m", 1).alias("iv"), at("u_m", -1).alias("ju"), at("v_m", -1).alias("jv"))


def grid(vis: DataFrame, where: DataFrame, n: int) -> DataFrame:
    """(chan, iv, iu, re, im): every visibility added to its cell, those of two antennas also mirrored and conjugated.

    Cells outside 0..n-1 are dropped. Sparse: cells that nothing falls into have no row.
    """
    rows = vis.join(where, ["chan", "ant_i", "ant_j"])
    here = F.struct(F.col("iv").alias("iv"), F.col("iu").alias("iu"), F.col("re").alias("re"), F.col("im").alias("im"))
    there = F.struct(F.col("jv").alias("iv"), F.col("ju").alias("iu"), F.col("re").alias("re"), (-F.col("im")).alias("im"))
    both = F.when(F.col("ant_i") == F.col("ant_j"), F.array(here)).otherwise(F.array(here, there))
    rows = rows.select("chan", F.explode(both).alias("g")).select("chan", "g.*")
    inside = (F.col("iv") >= 0) & (F.col("iv") < n) & (F.col("iu") >= 0) & (F.col("iu") < n)
    return rows.where(inside).groupBy("chan", "iv", "iu").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def tapered(g: DataFrame, taper: DataFrame | None) -> DataFrame:
    """Cells times w of taper(iv, iu, w); a cell without one stays as it is."""
    if taper is None:
        return g
    w = F.coalesce(F.col("w"), F.lit(1.0))
    return g.join(taper, ["iv", "iu"], "left").select("chan", "iv", "iu", (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im"))


def intensity(g: DataFrame, pixels: DataFrame, n: int, form: str | None = None) -> DataFrame:
    """(chan, beam, value): |image|^2 / n^2 at pixels(beam, row, col); a pixel outside the image is zero.

    form "sparse" is the Fourier sum over the grid's cells at those pixels only: a row for each cell and pixel,
    summed at once on the map side, no dense plane. form "dense" transforms each channel's plane and joins it
    with the pixels. Without a form the pixels are counted: up to FEW_PIXELS the sum is taken.
    """
    if form is None:
        form = "sparse" if pixels.limit(FEW_PIXELS + 1).count() <= FEW_PIXELS else "dense"
    if form == "dense":
        return intensity_fft(g, pixels, n)
    if form != "sparse":
        raise ValueError("form must be sparse or dense")
    parts = max(1, -(-pixels.count() // PIXELS_MET))  # cells meet the pixels part by part
    p = pixels.select("beam", "row", "col", F.pmod(F.xxhash64("beam"), F.lit(parts)).cast("int").alias("_p"))
    rows = g.select("chan", "iv", "iu", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p")).join(p, "_p")
    angle = F.lit(2 * math.pi / n) * ((F.col("row") * F.col("iv") + F.col("col") * F.col("iu")) % n)
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    z = rows.groupBy("chan", "beam", "row", "col").agg(F.sum(re).alias("zr"), F.sum(im).alias("zi"))
    inside = (F.col("row") >= 0) & (F.col("row") < n) & (F.col("col") >= 0) & (F.col("col") < n)
    return z.select("chan", "beam", F.when(inside, (F.col("zr") * F.col("zr") + F.col("zi") * F.col("zi")) / (n * n)).otherwise(0.0).alias("value"))


def _planes(g: DataFrame, n: int, out: str, take):
    def run(key, table):
        plane = np.zeros((n, n), np.complex128)
        np.add.at(plane, (table["iv"].to_numpy(), table["iu"].to_numpy()), table["re"].to_numpy().astype(float) + 1j * table["im"].to_numpy().astype(float))
        return take(table["chan"][0], np.fft.ifft2(plane) * (n * n))

    return g.groupBy("chan").applyInArrow(run, out)


def image(g: DataFrame, n: int) -> DataFrame:
    """(chan, row, col, re, im): the whole plane of each channel by an inverse transform without scale or shift."""

    def take(chan, z):
        row, col = np.divmod(np.arange(n * n), n)
        return pa.table({"chan": pa.array([chan.as_py()] * (n * n), chan.type), "row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), "re": z.real.ravel(), "im": z.imag.ravel()})

    kind = dict(g.dtypes)["chan"]
    return _planes(g, n, f"chan {kind}, row int, col int, re double, im double", take)


def intensity_fft(g: DataFrame, pixels: DataFrame, n: int) -> DataFrame:
    """As intensity(), by a transform of each channel's whole plane (n x n, one group), joined with the pixels."""

    def take(chan, z):
        row, col = np.divmod(np.arange(n * n), n)
        kinds, outside = pa.int32(), [-1]  # a cell of its own for pixels that lie outside
        power = np.append((z.real**2 + z.imag**2).ravel() / (n * n), 0.0)
        return pa.table({"chan": pa.array([chan.as_py()] * (n * n + 1), chan.type), "row": pa.array(np.append(row, outside), kinds), "col": pa.array(np.append(col, outside), kinds), "value": power})

    inside = (F.col("row") >= 0) & (F.col("row") < n) & (F.col("col") >= 0) & (F.col("col") < n)
    at = pixels.select("beam", *[F.when(inside, F.col(c)).otherwise(-1).cast("int").alias(c) for c in ("row", "col")])
    return _planes(g, n, f"chan {dict(g.dtypes)['chan']}, row int, col int, value double", take).join(at, ["row", "col"]).select("chan", "beam", "value")


def quantised(beams: DataFrame, scale: float = 1.0) -> DataFrame:
    return beams.withColumn("value", bits.quantise_half_up(F.col("value") * F.lit(scale)))
