"""Packed 4-bit complex samples, low-precision formats and quantisers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def low(byte: Column) -> Column:
    return byte.bitwiseAND(F.lit(15))


def high(byte: Column) -> Column:
    return F.shiftright(byte, 4).bitwiseAND(F.lit(15))


def twos(n: Column) -> Column:
    """A nibble as two's complement: -8 to 7."""
    return F.when(n > 7, n - 16).otherwise(n)


def sign_magnitude(n: Column) -> Column:
    """A nibble as sign and magnitude: -7 to 7; minus zero is zero."""
    return F.when(n >= 8, 8 - n).otherwise(n)


def decode_twos(byte: Column) -> tuple[Column, Column]:
    """(re, im): low nibble real, high nibble imaginary."""
    return twos(low(byte)), twos(high(byte))


def decode_sign_magnitude(byte: Column) -> tuple[Column, Column]:
    """(re, im): high nibble real, low nibble imaginary."""
    return sign_magnitude(high(byte)), sign_magnitude(low(byte))


def pack_twos(re: Column, im: Column) -> Column:
    return F.shiftleft(im.bitwiseAND(F.lit(15)), 4).bitwiseOR(re.bitwiseAND(F.lit(15)))


def repack(byte: Column) -> Column:
    """From sign and magnitude (real high) to two's complement (real low)."""
    return pack_twos(*decode_sign_magnitude(byte))


def fp4(x: Column) -> Column:
    """Whole numbers up to 7 as a 4-bit float holds them: 5 becomes 4 and 7 becomes 8."""
    a = F.abs(x)
    return F.signum(x).cast("int") * F.when(a == 5, 4).when(a == 7, 8).otherwise(a)


def saturate(x: Column, most: float = 448.0) -> Column:
    """The range of an 8-bit float with four exponent bits."""
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most))


def _u8(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(255.0)), F.lit(0.0)).cast("int")


def quantise_even(x: Column, scale: float = 1.0) -> Column:
    """Scaled, rounded half to even, clamped to 0..255."""
    return _u8(F.rint(x * F.lit(scale)))


def quantise_half_up(x: Column) -> Column:
    """Clamped, then rounded half up."""
    return F.floor(F.greatest(F.least(x, F.lit(255.0)), F.lit(0.0)) + 0.5).cast("int")


def quantise_half_away(x: Column) -> Column:
    """Rounded half away from zero, then clamped."""
    return _u8(F.signum(x) * F.floor(F.abs(x) + 0.5))


def quantise_truncate(x: Column) -> Column:
    """Cut to a whole number, then clamped (what lies outside 0..255 is ours to define)."""
    return _u8(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def quantise_zero_mean(x: Column) -> Column:
    """A zero-mean value around 127.5, rounded half away from zero."""
    return quantise_half_away(x + F.lit(127.5))


#: Fixed values of floating-point formats: bits of the fraction, least exponent of a normal number, largest finite value.
FORMATS = {"half": (10, -14, 65504.0), "bfloat16": (7, -126, 3.3895313892515355e38), "e4m3": (3, -6, 448.0), "e5m2": (2, -14, 57344.0)}


def as_float(x: Column, form: str = "half", saturated: bool = False) -> Column:
    """x as a narrow float of FORMATS holds it: rounded half to even, below the normal numbers too.

    What rounds beyond the largest value becomes infinite, or that value if saturated. Null and nan stay.
    """
    fraction, least, most = FORMATS[form]
    a = F.abs(x.cast("double"))
    e = F.floor(F.log2(F.when(a > 0, a)))
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)  # log2 may miss by one
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(least)) - fraction)
    r = F.rint(a / step) * step
    r = F.when(r > most, F.lit(most if saturated else float("inf"))).otherwise(r)
    return F.when((a == 0) | F.isnan(x.cast("double")) | (a == float("inf")) & F.lit(not saturated), x.cast("double")).when(a == float("inf"), F.signum(x) * most).otherwise(F.signum(x) * r)
