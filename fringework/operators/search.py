"""Pulse search: boxcars, signal to noise, candidates, masking and verification."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

CANDIDATE = "beam bigint, dm double, time_s double, snr double, intensity double, dm_idx int, time_idx bigint, width int"


def boxcar(x: DataFrame, width: int, keys: Sequence[str] = ("beam", "dm_idx"), value: str = "value") -> DataFrame:
    """(keys, t, value): sums of ``width`` samples from t on; only starts where all are there."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, width - 1)
    return x.select(*keys, "t", F.sum(value).over(w).alias("value"), F.count("*").over(w).alias("_n")).where(F.col("_n") == width).drop("_n")


def gaussian(x: DataFrame, width: int, keys: Sequence[str] = ("beam", "dm_idx"), value: str = "value") -> DataFrame:
    """(keys, t, value): a mean weighted by a normal curve with sigma = width / 4, over ``width`` samples around t; weights sum to one."""
    half = width // 2
    sigma = max(width / 4.0, 1e-9)
    shape = np.exp(-0.5 * ((np.arange(width) - half) / sigma) ** 2)
    shape /= shape.sum()
    parts = F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(float(w)).alias("w")) for k, w in enumerate(shape)])
    ends = x.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    rows = x.select(*keys, "t", F.col(value).alias("_v"), F.explode(parts).alias("p")).select(*keys, (F.col("t") - F.col("p.o")).alias("t"), (F.col("_v") * F.col("p.w")).alias("_v"))
    return rows.join(ends, list(keys)).where("t between _a and _b").groupBy(*keys, "t").agg(F.sum("_v").alias("value"))


def best_widths(x: DataFrame, widths: Sequence[int], mean: float, sigma: float, keys: Sequence[str] = ("beam", "dm_idx"), value: str = "value", block: int | None = None) -> DataFrame:
    """(keys, width, snr, intensity, time_idx): the best boxcar of each series.

    One window for each width over the same partitioning, so one shuffle serves all. Of equal S/N the width
    that is named first and then the earliest time wins. intensity is the boxcar's sum. With ``block`` a series is
    cut into blocks of so many times (from 0 on), which also see the widest boxcar's next samples: the result is
    the same, and no task has to sort more than that.
    """
    rows, cut = x.select(*keys, "t", value), []
    if block is not None:
        last = F.floor(F.col("t") / block).cast("bigint")
        first = F.greatest(F.ceil((F.col("t") - (block + max(widths) - 1) + 1) / block).cast("bigint"), F.lit(0))
        rows, cut = rows.withColumn("_block", F.explode(F.sequence(first, last))), ["_block"]
    by = Window.partitionBy(*keys, *cut).orderBy("t")
    for k, w in enumerate(widths):
        frame = by.rowsBetween(0, w - 1)
        s = F.sum(value).over(frame)
        rows = rows.withColumn(f"_s{k}", F.when(F.count("*").over(frame) == w, s))
    sums = [F.col(f"_s{k}").cast("double") for k in range(len(widths))]
    cells = [F.struct(((s - w * mean) / (sigma * math.sqrt(w))).alias("snr"), F.lit(-k).alias("first"), (-F.col("t")).alias("t"), s.alias("sum"), F.lit(w).alias("width")) for k, (w, s) in enumerate(zip(widths, sums))]
    best = [F.max(F.when(s.isNotNull(), c)).alias(f"_b{k}") for k, (s, c) in enumerate(zip(sums, cells))]
    if block is not None:
        rows = rows.where(F.col("t") < (F.col("_block") + 1) * block)
    rows = rows.groupBy(*keys).agg(*best)
    top = F.greatest(*[F.col(f"_b{k}") for k in range(len(widths))]) if len(widths) > 1 else F.col("_b0")
    return rows.select(*keys, top.alias("b")).where("b is not null").select(*keys, F.col("b.width").alias("width"), F.col("b.snr").alias("snr"), F.col("b.sum").alias("intensity"), (-F.col("b.t")).alias("time_idx"))


def candidates(best: DataFrame, dms: DataFrame, dt: float, most: int | None = None) -> DataFrame:
    """The best trial of each beam with S/N over 0, as CANDIDATE rows; the first ``most`` in order of beam."""
    pick = F.max(F.struct("snr", (-F.col("dm_idx")).alias("d"), (-F.col("time_idx")).alias("t"), "intensity", "width"))
    rows = best.groupBy("beam").agg(pick.alias("b")).where("b.snr > 0").select("beam", "b.snr", "b.intensity", "b.width", (-F.col("b.d")).alias("dm_idx"), (-F.col("b.t")).alias("time_idx"))
    rows = rows.join(dms, "dm_idx").select(
        F.col("beam").cast("bigint").alias("beam"), "dm", (F.col("time_idx") * F.lit(dt)).alias("time_s"), "snr", "intensity", F.col("dm_idx").cast("int").alias("dm_idx"), F.col("time_idx").cast("bigint").alias("time_idx"), F.col("width").cast("int").alias("width"),
    )
    return rows.orderBy("beam").limit(most) if most is not None else rows


def _clipped(x: np.ndarray, rounds: int = 3, sigmas: float = 3.0) -> tuple[float, float]:
    mean = sigma = 0.0
    for _ in range(rounds):
        if not len(x):
            break
        mean, sigma = float(x.mean()), float(np.sqrt(max(0.0, (x * x).mean() - x.mean() ** 2)))
        if sigma < 1e-9:
            break
        x = x[np.abs(x - mean) <= sigmas * sigma]
    return mean, sigma


def many_candidates(x: DataFrame, widths: Sequence[int], dms: Sequence[float], dt: float, most: int) -> DataFrame:
    """Up to ``most`` CANDIDATE rows a beam, strongest first: after each one, what is near it in trial and time is masked.

    A beam's plane of trials and times is one group, of a size that the trials and the block's length fix.
    """
    dm = np.asarray(dms, float)
    near = max(2, math.ceil(2.0 / (dm[1] - dm[0]))) if len(dm) > 1 else 2

    def run(key, table):
        n_t = int(np.max(table["t"].to_numpy(), initial=-1)) + 1
        plane = np.zeros((len(dm), n_t))
        plane[table["dm_idx"].to_numpy(), table["t"].to_numpy()] = table["value"].to_numpy()
        masked, out = np.zeros(plane.shape, bool), []
        for _ in range(most):
            best = None
            for w in widths:
                if w > n_t:
                    continue
                run_sum = np.cumsum(np.pad(plane, ((0, 0), (1, 0))), axis=1)
                hidden = np.cumsum(np.pad(masked.astype(np.int64), ((0, 0), (1, 0))), axis=1)
                s = np.where(hidden[:, w:] - hidden[:, :-w] > 0, -1e9, run_sum[:, w:] - run_sum[:, :-w])
                d, t = np.unravel_index(int(s.argmax()), s.shape)
                if s[d, t] <= -1e9:
                    continue
                off = np.ones(s.shape[1], bool)
                off[max(0, t - 2 * w) : t + 2 * w + 1] = False
                level = s[d][off & (s[d] > -1e9)]
                mean, sigma = _clipped(level)
                snr = (s[d, t] - mean) / sigma if sigma > 1e-9 else 0.0
                if best is None or snr > best[0]:
                    best = (snr, int(d), int(t), w, float(s[d, t]))
            if best is None or best[0] <= 0:
                break
            snr, d, t, w, total = best
            out.append((key[0].as_py(), float(dm[d]), t * dt, snr, total, d, t, w))
            masked[max(0, d - near) : d + near + 1, max(0, t - max(10, w)) : t + max(10, w) + 1] = True
        names = [c.split()[0] for c in CANDIDATE.split(", ")]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int32()]
        cols = list(zip(*out)) or [()] * len(names)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})

    rows = x.select(F.col("beam").cast("bigint").alias("beam"), F.col("dm_idx").cast("int").alias("dm_idx"), F.col("t").cast("bigint").alias("t"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("beam").applyInArrow(run, CANDIDATE)


def verified(found: DataFrame, truth: DataFrame, ddm: float = 5.0, dt: float = 0.05, snr: float = 5.0) -> DataFrame:
    """(beam, matched): whether a beam's candidate is the burst that truth(beam, dm, t0_s) has; beams without one are not matched."""
    t = truth.select("beam", F.col("dm").alias("_dm"), F.col("t0_s").alias("_t"))
    ok: Column = (F.abs(F.col("dm") - F.col("_dm")) < ddm) & (F.abs(F.col("time_s") - F.col("_t")) < dt) & (F.col("snr") > snr)
    return t.join(found, "beam", "left").groupBy("beam").agg(F.max(F.coalesce(ok, F.lit(False))).alias("matched"))
