"""Complex arithmetic on pairs of columns; Catalyst sees plain double expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class C:
    """A complex value: real and imaginary part."""

    re: Column
    im: Column

    def __add__(self, o: C) -> C:
        return C(self.re + o.re, self.im + o.im)

    def __sub__(self, o: C) -> C:
        return C(self.re - o.re, self.im - o.im)

    def __mul__(self, o: C) -> C:
        return C(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o: C) -> C:
        n = o.norm()
        return C((self.re * o.re + self.im * o.im) / n, (self.im * o.re - self.re * o.im) / n)

    def __neg__(self) -> C:
        return C(-self.re, -self.im)

    def scaled(self, x: Column) -> C:
        return C(self.re * x, self.im * x)

    def conj(self) -> C:
        return C(self.re, -self.im)

    def norm(self) -> Column:
        """The square of the absolute value."""
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    def arg(self) -> Column:
        return F.atan2(self.im, self.re)

    def exp(self) -> C:
        return polar(F.exp(self.re), self.im)

    def log(self) -> C:
        return C(F.log(self.abs()), self.arg())

    def log10(self) -> C:
        return self.log().scaled(F.lit(1.0) / F.log(F.lit(10.0)))

    def pow(self, o: C) -> C:
        return (self.log() * o).exp()

    def sqrt(self) -> C:
        """The root with a real part that isn't negative."""
        r = self.abs()
        im = F.sqrt(F.greatest((r - self.re) / 2, F.lit(0.0)))
        return C(F.sqrt(F.greatest((r + self.re) / 2, F.lit(0.0))), F.when(self.im < 0, -im).otherwise(im))

    def sinh(self) -> C:
        return C(F.sinh(self.re) * F.cos(self.im), F.cosh(self.re) * F.sin(self.im))

    def cosh(self) -> C:
        return C(F.cosh(self.re) * F.cos(self.im), F.sinh(self.re) * F.sin(self.im))

    def tanh(self) -> C:
        return self.sinh() / self.cosh()

    def sin(self) -> C:
        return C(F.sin(self.re) * F.cosh(self.im), F.cos(self.re) * F.sinh(self.im))

    def cos(self) -> C:
        return C(F.cos(self.re) * F.cosh(self.im), -F.sin(self.re) * F.sinh(self.im))

    def tan(self) -> C:
        return self.sin() / self.cos()

    def asinh(self) -> C:
        return (self + (self * self + ONE).sqrt()).log()

    def acosh(self) -> C:
        return (self + (self + ONE).sqrt() * (self - ONE).sqrt()).log()

    def atanh(self) -> C:
        return ((ONE + self).log() - (ONE - self).log()).scaled(F.lit(0.5))

    def asin(self) -> C:
        z = self.times_i().asinh()
        return C(z.im, -z.re)

    def acos(self) -> C:
        a = self.asin()
        return C(F.lit(1.5707963267948966) - a.re, -a.im)

    def atan(self) -> C:
        z = self.times_i().atanh()
        return C(z.im, -z.re)

    def times_i(self) -> C:
        return C(-self.im, self.re)

    def rounded(self, places: int) -> C:
        """Without minus zero."""
        return C(F.round(self.re, places) + 0.0, F.round(self.im, places) + 0.0)


def polar(r: Column, angle: Column) -> C:
    return C(r * F.cos(angle), r * F.sin(angle))


def of(re: str, im: str) -> C:
    return C(F.col(re).cast("double"), F.col(im).cast("double"))


class _One(C):
    def __init__(self):
        pass

    @property
    def re(self) -> Column:
        return F.lit(1.0)

    @property
    def im(self) -> Column:
        return F.lit(0.0)


ONE = _One()
