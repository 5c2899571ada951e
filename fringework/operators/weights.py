"""Steering weights and calibration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from fringework.functions import axes
from fringework.functions.cplx import C, polar

#: Beam separations in arc minutes, and the beam that looks straight up.
SEP, SEP_NS, MIDDLE = 1.0, 0.75, 127


def normalised(calib: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Calibration of unit size; zero stays zero, and flagged antennas become zero."""
    n = F.hypot("re", "im")
    rows, keep = calib, F.lit(True)
    if flags is not None:
        rows = calib.join(F.broadcast(flags.select("ant", F.lit(1).alias("_f"))), "ant", "left")
        keep = F.col("_f").isNull()
    part = lambda c: F.when(~keep, 0.0).when(n > 0, F.col(c) / n).otherwise(F.col(c))
    return rows.select("ant", "fq", "pol", part("re").alias("re"), part("im").alias("im"))


def channels(spark, n: int, top_mhz: float = 1498.75, width_mhz: float = 250 / 1024) -> DataFrame:
    """(fq, hz)."""
    return spark.range(n).select(F.col("id").cast("int").alias("fq"), axes.channel_hz(F.col("id"), top_mhz, width_mhz).alias("hz"))


def steering(geometry: DataFrame, calib: DataFrame, freqs: DataFrame, beams: int, dec: float, sep: float = SEP, sep_ns: float = SEP_NS, middle: int = MIDDLE) -> DataFrame:
    """(arm, fq, beam, ant, pol, re, im): a phase for each beam and antenna, times the calibration.

    Arm 0 steers by the angle along e, arm 1 by its sine along n, less the declination. The tables are
    as small as the array; calibration and frequencies meet by equi-join and beams are exploded.
    """
    rows = calib.withColumnsRenamed({"re": "cr", "im": "ci"}).join(geometry, "ant").join(freqs, "fq")
    rows = rows.withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("beam", F.explode(F.sequence(F.lit(0), F.lit(beams - 1))))
    step = (middle - F.col("beam")) * math.pi / 10800
    along = F.when(F.col("arm") == 0, F.lit(sep) * step * F.col("e")).otherwise(F.sin(F.lit(sep_ns) * step - F.lit(math.pi / 180 * dec)) * F.col("n"))
    phase = -2.0 * math.pi * F.col("hz") * along / F.lit(axes.LIGHT)
    w = polar(F.lit(1.0), phase) * C(F.col("cr"), F.col("ci"))
    return rows.select("arm", "fq", "beam", "ant", "pol", w.re.alias("re"), w.im.alias("im"))


def steering_by_arm(geometry: DataFrame, calib: DataFrame, freqs: DataFrame, beams: int, dec: float, n_ant: int, **how) -> DataFrame:
    """As steering(), where the first half of the antennas is arm 0 and the second arm 1."""
    w = steering(geometry, calib, freqs, beams, dec, **how)
    return w.where(F.col("arm") == F.floor(F.col("ant") / (n_ant // 2)))
