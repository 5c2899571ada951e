"""Packed samples to whole-number complex samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fringework.functions import bits


def decode(voltage: DataFrame, form: str = "sign_magnitude") -> DataFrame:
    """Adds re and im to rows with a byte. form: sign_magnitude (real high) or twos (real low)."""
    pair = {"sign_magnitude": bits.decode_sign_magnitude, "twos": bits.decode_twos}[form]
    re, im = pair(F.col("byte"))
    return voltage.withColumns({"re": re.cast("bigint"), "im": im.cast("bigint")})


def split_time(voltage: DataFrame, inner: int, blocked: int | None = None) -> DataFrame:
    """Adds t_inner and k: t = k * inner + t_inner, or with ``blocked`` = K, t = t_inner * K + k."""
    t = F.col("t")
    if blocked:
        return voltage.withColumns({"t_inner": F.floor(t / blocked).cast("int"), "k": (t % blocked).cast("bigint")})
    return voltage.withColumns({"t_inner": (t % inner).cast("int"), "k": F.floor(t / inner).cast("bigint")})
