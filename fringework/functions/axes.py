"""Numbers of triangles, channels, trials, delays and grid cells, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LIGHT = 299792458.0
#: Dispersion constant in seconds for GHz.
DISPERSION = 4.15e-3


def lower_index(row: Column, col: Column) -> Column:
    """Place of (row, col <= row) in a packed lower triangle."""
    return F.floor(row * (row + 1) / 2).cast("bigint") + col


def lower_row(k: Column) -> Column:
    """The row of a place in a packed lower triangle; the root is put right in whole numbers."""
    r = F.floor((F.sqrt(8.0 * k + 1.0) - 1.0) / 2.0).cast("bigint")
    t = lambda x: F.floor(x * (x + 1) / 2).cast("bigint")
    return F.when(t(r) > k, r - 1).when(t(r + 1) <= k, r + 1).otherwise(r)


def upper_index(i: Column, j: Column, n: int) -> Column:
    """Place of (i, j >= i) in a packed upper triangle of n rows, row after row."""
    return (i * n + j - F.floor(i * (i + 1) / 2)).cast("bigint")


def channel_hz(i: Column, top_mhz: float = 1498.75, width_mhz: float = 250 / 1024) -> Column:
    return 1e6 * (F.lit(top_mhz) - i * F.lit(width_mhz))


def dm_trial(i: Column, n: int, low: float, high: float) -> Column:
    return F.lit(low) if n == 1 else F.lit(low) + i / F.lit(float(n - 1)) * F.lit(high - low)


def delay_s(dm: Column, ghz: Column, ref_ghz: float, constant: float = DISPERSION) -> Column:
    """Later by so many seconds than at the reference frequency."""
    return F.lit(constant) * dm * (1.0 / (ghz * ghz) - F.lit(1.0 / (ref_ghz * ref_ghz)))


def delay_mhz_s(dm: Column, mhz: Column, ref_mhz: float, constant: float = 4.15e3) -> Column:
    return F.lit(constant) * dm * (1.0 / (mhz * mhz) - F.lit(1.0 / (ref_mhz * ref_mhz)))


def padded_length(n_time: int, most_delay_s: float, dt: float) -> tuple[int, int]:
    """(samples, bins of a real transform): the next power of two that holds the series and the largest delay."""
    n = 1 << max(0, (n_time + math.ceil(most_delay_s / dt) - 1)).bit_length()
    return n, n // 2 + 1


def bin_hz(k: Column, padded: int, dt: float) -> Column:
    return k / F.lit(padded * dt)


def half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("bigint")


def cell(metres: Column, hz: Column, size: float, n: int) -> Column:
    """Grid cell of a baseline coordinate; the centre is n / 2."""
    return half_away(metres / (F.lit(LIGHT) / hz) / F.lit(size) + F.lit(n / 2))
