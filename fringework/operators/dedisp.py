"""Dedispersion: by shifts in time, by phases in frequency, and by a tree; signal injection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fringework.functions import axes

#: Rows of shifts or of a tree's plan that are sent whole to every executor, and parts of the time that more of them meet.
MOST_SENT, SPREAD = 500_000, 32


def channel_ghz(i: np.ndarray | int, n: int, low_ghz: float, high_ghz: float, at: str = "edge"):
    """A channel's frequency: its lower edge, or its centre."""
    return low_ghz + (np.asarray(i, float) + (0.5 if at == "centre" else 0.0)) * (high_ghz - low_ghz) / n


def trials(spark: SparkSession, n: int, low: float, high: float) -> DataFrame:
    """(dm_idx, dm)."""
    return spark.range(n).select(F.col("id").cast("int").alias("dm_idx"), axes.dm_trial(F.col("id"), n, low, high).alias("dm"))


def delays(dms: DataFrame, n_chan: int, low_ghz: float, high_ghz: float, dt: float, at: str = "edge") -> DataFrame:
    """(dm_idx, dm, chan, tau, shift): how much later a channel is than the band's top, in seconds and samples."""
    half = 0.5 if at == "centre" else 0.0
    rows = dms.withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(n_chan - 1))))
    ghz = F.lit(low_ghz) + (F.col("chan") + half) * F.lit((high_ghz - low_ghz) / n_chan)
    rows = rows.withColumn("tau", axes.delay_s(F.col("dm"), ghz, high_ghz))
    return rows.withColumn("shift", axes.half_away(F.col("tau") / F.lit(dt)))


def _met(fb: DataFrame, shifts: DataFrame) -> DataFrame:
    """fb with the trials and shifts of each sample's channel.

    Up to MOST_SENT rows of shifts are sent whole. More are joined by channel and a part of the time, so that
    a few channels don't make a few huge partitions; each of the SPREAD parts has its own copy of the shifts.
    """
    s = shifts.select("chan", "dm_idx", "shift")
    if s.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return fb.join(F.broadcast(s), "chan")
    part = F.pmod(F.xxhash64(F.floor(F.col("t") / 1024)), F.lit(SPREAD)).cast("int")
    s = s.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return fb.withColumn("_part", part).join(s, ["chan", "_part"]).drop("_part")


def shifted_sum(fb: DataFrame, shifts: DataFrame, n_time: int | None = None, complete: bool = False) -> DataFrame:
    """(beam, dm_idx, t, value): the sum over channels of x at t + shift. What lies outside the series is not there.

    shifts has a row for each trial and channel. Sums start on the map side. complete keeps the times only that
    every channel reaches in every trial: t under n_time less the largest shift.
    """
    rows = _met(fb, shifts).withColumn("t", F.col("t") - F.col("shift")).where("t >= 0")
    if n_time is not None:
        most = (shifts.agg(F.max("shift")).first()[0] or 0) if complete else 0
        rows = rows.where(F.col("t") < n_time - most)
    return rows.groupBy("beam", "dm_idx", "t").agg(F.sum("x").alias("value"))


def fourier(fb: DataFrame, tau: np.ndarray, n_time: int, dt: float, block: int | None = None) -> DataFrame:
    """(beam, dm_idx, t, value double): as shifted_sum() for delays of any length, by phases.

    tau[dm, chan] in seconds. Each beam's block is padded to a power of two that holds the largest delay,
    transformed, turned by +2 pi i f tau, summed over channels and transformed back. A beam's block (channels
    times samples) is one group. With ``block`` a long series goes through in blocks of so many samples, each of
    which also sees what its largest delay reaches: the same for delays of whole samples; else interpolation
    ends at a block's border.
    """
    if block is not None and block < n_time:
        over = math.ceil(float(tau.max(initial=0.0)) / dt) + 1
        cut = blocks(fb.where((F.col("t") >= 0) & (F.col("t") < n_time)), block, over)
        n_block = -(-n_time // block)  # a block of a beam passes as a beam of its own
        cut = cut.select((F.col("beam").cast("bigint") * n_block + F.col("block")).alias("beam"), "chan", (F.col("t") - F.col("block") * block).alias("t"), "x")
        out = fourier(cut, tau, block + over, dt).where(F.col("t") < block)
        at = F.pmod("beam", F.lit(n_block))
        return out.select(((F.col("beam") - at) / n_block).cast("bigint").alias("beam"), "dm_idx", (F.col("t") + at * block).alias("t"), "value").where(F.col("t") < n_time)
    padded, bins = axes.padded_length(n_time, float(tau.max(initial=0.0)), dt)
    f = np.arange(bins) / (padded * dt)
    n_dm, n_chan = tau.shape

    def run(key, table):
        x = np.zeros((n_chan, n_time))
        chan, t = table["chan"].to_numpy(), table["t"].to_numpy()
        ok = (t >= 0) & (t < n_time) & (chan >= 0) & (chan < n_chan)
        np.add.at(x, (chan[ok], t[ok]), table["x"].to_numpy()[ok])
        z = np.fft.rfft(x, padded, axis=1)
        out = np.empty((n_dm, n_time))
        for d in range(n_dm):
            out[d] = np.fft.irfft((z * np.exp(2j * np.pi * np.outer(tau[d], f))).sum(axis=0), padded)[:n_time]
        dm, time = np.divmod(np.arange(n_dm * n_time), n_time)
        return pa.table({"beam": pa.array([key[0].as_py()] * len(dm), pa.int64()), "dm_idx": pa.array(dm, pa.int32()), "t": pa.array(time, pa.int64()), "value": out.ravel()})

    rows = fb.select(F.col("beam").cast("bigint").alias("beam"), F.col("chan").cast("int").alias("chan"), F.col("t").cast("bigint").alias("t"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("beam").applyInArrow(run, "beam bigint, dm_idx int, t bigint, value double")


def dispersed_again(spectra: DataFrame, tau: np.ndarray, n_time: int, dt: float) -> DataFrame:
    """(beam, chan, t, x): the inverse of fourier() with the conjugate phases over the number of trials; exact for what all trials share."""
    padded, bins = axes.padded_length(n_time, float(tau.max(initial=0.0)), dt)
    f = np.arange(bins) / (padded * dt)
    n_dm, n_chan = tau.shape

    def run(key, table):
        y = np.zeros((n_dm, n_time))
        y[table["dm_idx"].to_numpy(), table["t"].to_numpy()] = table["value"].to_numpy()
        z = np.fft.rfft(y, padded, axis=1)
        x = np.stack([np.fft.irfft((z * np.exp(-2j * np.pi * np.outer(tau[:, c], f))).sum(axis=0) / n_dm, padded)[:n_time] for c in range(n_chan)])
        chan, t = np.divmod(np.arange(n_chan * n_time), n_time)
        return pa.table({"beam": pa.array([key[0].as_py()] * len(t), pa.int64()), "chan": pa.array(chan, pa.int32()), "t": pa.array(t, pa.int64()), "x": x.ravel()})

    return spectra.groupBy("beam").applyInArrow(run, "beam bigint, chan int, t bigint, x double")


def tree_plan(n_chan: int, n_dm: int, low_ghz: float, high_ghz: float, dt: float) -> list[list[tuple[int, int, int, int, int]]]:
    """For each stage the rows (sub, lag, of_high, of_low, shift).

    Two neighbouring bands become one. For a lag over the joint band, each half takes its share of it,
    rounded half away from zero, and the upper half comes later by the delay between the bands.
    """
    inv = 1.0 / channel_ghz(np.arange(n_chan), n_chan, low_ghz, high_ghz, "centre") ** 2
    near = lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))
    most, before, stages, width = n_dm - 1, 0, [], 2
    while width <= n_chan:
        rows = []
        for sub in range(n_chan // width):
            lo, mid, hi = sub * width, sub * width + width // 2, (sub + 1) * width - 1
            band = inv[lo] - inv[hi]
            top = min(math.ceil(most * band / ((inv[0] - inv[-1]) or 1e-9)), most)
            for lag in range(top + 1):
                part = lag / (band or 1e-9)
                of_high, of_low = near(part * (inv[mid] - inv[hi])), near(part * (inv[lo] - inv[mid - 1]))
                if 0 <= of_high <= before and 0 <= of_low <= before:
                    rows.append((sub, lag, of_high, of_low, near(part * (inv[lo] - inv[mid]))))
        stages.append(rows)
        before, width = most, width * 2
    return stages


def tree(fb: DataFrame, n_chan: int, n_dm: int, low_ghz: float, high_ghz: float, dt: float, folder: str | None = None) -> DataFrame:
    """(beam, dm_idx, t, value) of the fast tree: a number of channels that is a power of two, aligned at the lowest channel.

    Every stage is one equi-join with its plan (trials times bands rows, sent whole up to MOST_SENT) and one grouped sum.
    Cells that a stage does not reach are zero. With ``folder`` every third stage is written there.
    """
    spark = fb.sparkSession
    state = fb.select("beam", F.col("chan").alias("sub"), F.lit(0).alias("lag"), "t", F.col("x").alias("v"))
    for k, plan in enumerate(tree_plan(n_chan, n_dm, low_ghz, high_ghz, dt)):
        uses = [(2 * s + 1, h, s, lag, shift) for s, lag, h, _, shift in plan] + [(2 * s, w, s, lag, 0) for s, lag, _, w, _ in plan]
        m = spark.createDataFrame(uses, "sub int, lag int, to_sub int, to_lag int, shift int")
        rows = state.join(F.broadcast(m) if len(uses) <= MOST_SENT else m, ["sub", "lag"]).select("beam", F.col("to_sub").alias("sub"), F.col("to_lag").alias("lag"), (F.col("t") + F.col("shift")).alias("t"), "v")
        ends = fb.groupBy("beam").agg(F.max("t").alias("end")) if k == 0 else ends
        state = rows.join(ends, "beam").where("t <= end").groupBy("beam", "sub", "lag", "t").agg(F.sum("v").alias("v"))
        if folder and k % 3 == 2:
            path = f"{folder}/stage-{k}"
            state.write.parquet(path)
            state = spark.read.schema(state.schema).parquet(path)
    return state.where("sub = 0").select("beam", F.col("lag").alias("dm_idx"), "t", F.col("v").alias("value"))


def inject(fb: DataFrame, bursts: DataFrame, n_chan: int, n_time: int, low_ghz: float, high_ghz: float, dt: float) -> DataFrame:
    """fb with bursts(beam, dm, amplitude, t0_s): the amplitude is added where each channel's delay puts it; width and scattering don't count."""
    rows = bursts.withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(n_chan - 1))))
    ghz = F.lit(low_ghz) + F.col("chan") * F.lit((high_ghz - low_ghz) / n_chan)
    t = F.floor((F.col("t0_s") + axes.delay_s(F.col("dm"), ghz, high_ghz)) / F.lit(dt)).cast("bigint")
    new = rows.select("beam", "chan", t.alias("t"), F.col("amplitude").alias("x")).where((F.col("t") >= 0) & (F.col("t") < n_time))
    return fb.select("beam", "chan", "t", "x").unionByName(new).groupBy("beam", "chan", "t").agg(F.sum("x").alias("x"))


def blocks(fb: DataFrame, size: int, overlap: int) -> DataFrame:
    """fb with a column block: samples of [k * size, k * size + size + overlap) have block k; overlapped ones are there twice."""
    first = F.greatest(F.ceil((F.col("t") - (overlap + size) + 1) / size).cast("bigint"), F.lit(0))
    return fb.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("t") / size).cast("bigint"))))


def dedispersed_blocks(fb: DataFrame, shifts: DataFrame, size: int) -> DataFrame:
    """As shifted_sum() on an endless series, block by block: each block also sees the samples that its largest shift needs."""
    most = shifts.agg(F.max("shift")).first()[0] or 0
    rows = _met(blocks(fb, size, int(most)), shifts).withColumn("t", F.col("t") - F.col("shift"))
    rows = rows.where((F.col("t") >= F.col("block") * size) & (F.col("t") < (F.col("block") + 1) * size))
    return rows.groupBy("beam", "block", "dm_idx", "t").agg(F.sum("x").alias("value"))
