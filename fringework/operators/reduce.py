"""Map-reduce over vectors, beam power sums, moments and error measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fringework.functions import bits


def transformer(name: str) -> Column:
    """What is done to an element before it is reduced."""
    re, im = F.col("re"), F.col("im")
    return {
        "identity": lambda: re,
        "square": lambda: re * re + im * im,
        "abs": lambda: F.hypot(re.cast("double"), im.cast("double")),
        "abs_max": lambda: F.greatest(F.abs(re), F.abs(im)),
        "abs_min": lambda: F.least(F.abs(re), F.abs(im)),
    }[name]()


REDUCERS = {"plus": F.sum, "max": F.max, "min": F.min}


def transform_reduce(vectors: DataFrame, reducer: str = "plus", transform: str = "identity", batch: Sequence[str] = ("batch",), scale: float | None = None, subset: Column | None = None) -> DataFrame:
    """(batch, value). scale turns fixed-point elements into numbers; subset picks elements."""
    rows = vectors.where(subset) if subset is not None else vectors
    x = transformer(transform)
    if scale is not None:
        x = x * F.lit(scale * scale if transform == "square" else scale)
    return rows.groupBy(*batch).agg(REDUCERS[reducer](x).alias("value"))


def strided(index: str, width: int, geometry: int, dim: int) -> Column:
    """Elements whose stripe of ``width`` is number ``dim`` of every ``geometry``."""
    return F.floor(F.col(index) / width) % geometry == dim


def vector_reduce(v: DataFrame) -> DataFrame:
    return v.agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def all_reduce(v: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum, maximum, minimum and exclusive or over all parts."""
    x = F.col(value)
    return v.groupBy(*keys).agg(F.sum(x).alias("total"), F.max(x).alias("most"), F.min(x).alias("least"), F.bit_xor(x).alias("parity"))


def scale_vector(v: DataFrame, factor: float, value: str = "value") -> DataFrame:
    return v.withColumn(value, F.col(value) * F.lit(factor))


def axpby(x: DataFrame, y: DataFrame, a: float, b: float, keys: Sequence[str]) -> DataFrame:
    """a x + b y element by element; a missing element is zero."""
    part = lambda d, k: d.select(*keys, (F.col("value") * F.lit(k)).alias("value"))
    return part(x, a).unionByName(part(y, b)).groupBy(*keys).agg(F.sum("value").alias("value"))


def pol_reduce(tri: DataFrame, keys: Sequence[str] = ("chan", "t_inner")) -> DataFrame:
    return tri.groupBy(*keys, "ant_i", "ant_j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def incoherent_beam(v: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(chan, t, ib): power of all antennas that aren't flagged, both polarisations."""
    rows = v.join(F.broadcast(flags), "ant", "left_anti") if flags is not None else v  # a flag for each antenna at most
    return rows.groupBy("chan", "t").agg(F.sum(transformer("square")).alias("ib"))


def power_sum(beams: DataFrame, ib: DataFrame | None, factor: int = 4) -> DataFrame:
    """(chan, beam, t, value): power less the incoherent beam, over ``factor`` times."""
    rows = beams.groupBy("chan", "beam", "t").agg(F.sum(transformer("square")).alias("p"))
    if ib is not None:
        rows = rows.join(ib, ["chan", "t"]).withColumn("p", F.col("p") - F.col("ib"))
    return rows.groupBy("chan", "beam", F.floor(F.col("t") / factor).cast("bigint").alias("t")).agg(F.sum("p").alias("value"))


def inner_sum(ps: DataFrame, channels: int, times: int, offset: int = 70, scale: float = 1.0) -> DataFrame:
    """(beam, chan, t, value 0..255): channels and times summed, an offset added, cut to a byte."""
    g = ps.groupBy("beam", F.floor(F.col("chan") / channels).cast("int").alias("chan"), F.floor(F.col("t") / times).cast("bigint").alias("t"))
    return g.agg(F.sum("value").alias("s")).select("beam", "chan", "t", bits.quantise_truncate(F.col("s") * F.lit(scale) + offset).alias("value"))


def integrate(ps: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """(chan, beam, t, value): sums of ``factor`` consecutive times."""
    return ps.groupBy("chan", "beam", F.floor(F.col("t") / factor).cast("bigint").alias("t")).agg(F.sum(value).alias("value"))


def stokes_i(beams: DataFrame, factor: int = 1) -> DataFrame:
    """(chan, beam, t, value): power of both polarisations, over ``factor`` times."""
    g = beams.groupBy("chan", "beam", F.floor(F.col("t") / factor).cast("bigint").alias("t"))
    return g.agg(F.sum(transformer("square")).alias("value"))


def moments(x: DataFrame, keys: Sequence[str] = ("beam",), about: float = 70.0, value: str = "value") -> DataFrame:
    d = F.col(value) - about
    return x.groupBy(*keys).agg(F.avg(value).alias("mean"), F.avg(d * d).alias("mean_square"))


def robust(x: DataFrame, keys: Sequence[str], value: str = "x", rounds: int = 3, sigmas: float = 3.0) -> DataFrame:
    """(keys, mean, sigma) of what lies within ``sigmas`` of the round before, after ``rounds`` rounds.

    The last round's figures are those before its own clip. A group whose sigma is under 1e-9 is
    done. One aggregate and one join on the keys a round; the figures are one row for each group.
    """
    rows, v = x.select(*keys, F.col(value).cast("double").alias("_v")), F.col("_v")
    stats = None
    for k in range(rounds):
        new = rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0))).alias("sigma"))
        stats = new
        if k + 1 < rounds:
            lim = new.withColumnsRenamed({"mean": "_m", "sigma": "_s"})
            rows = rows.join(lim, list(keys)).where((F.col("_s") < 1e-9) | F.abs(v - F.col("_m")).between(0, sigmas * F.col("_s"))).select(*keys, "_v")
    return stats


def sample_stats(x: DataFrame, keys: Sequence[str], value: str = "x") -> DataFrame:
    return x.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"))


def absolute_max(z: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The largest part of any element, and the factor that takes it to 448."""
    most = F.max(F.greatest(F.abs("re"), F.abs("im")))
    return z.groupBy(*keys).agg(most.alias("most")).withColumn("scale", F.when(F.col("most") > 0, 448.0 / F.col("most")).otherwise(1.0))


def deviation(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frobenius norm of a - b, relative to b's, their root mean square, and b over the difference in dB."""
    part = lambda d, s: d.select(*keys, (F.col("re") * s).alias("dr"), (F.col("im") * s).alias("di"), F.lit(s).alias("s"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    d = part(a, 1).unionByName(part(b, -1)).groupBy(*keys).agg(F.sum("dr").alias("dr"), F.sum("di").alias("di"), F.sum(F.when(F.col("s") < 0, F.col("p")).otherwise(0)).alias("p"))
    e = d.agg(F.sum(F.col("dr") * F.col("dr") + F.col("di") * F.col("di")).alias("e"), F.sum("p").alias("p"), F.count("*").alias("n"))
    return e.select(F.sqrt("e").alias("frobenius"), F.sqrt(F.col("e") / F.col("p")).alias("relative"), F.sqrt(F.col("e") / F.col("n")).alias("rms"), F.when(F.col("e") > 0, 10 * F.log10(F.col("p") / F.col("e"))).alias("snr_db"))


def image_stats(z: DataFrame, keys: Sequence[str] = ("chan",)) -> DataFrame:
    """Mean and coefficient of variation of the absolute values."""
    a = transformer("abs")
    return z.groupBy(*keys).agg(F.avg(a).alias("mean"), (F.stddev_pop(a) / F.avg(a)).alias("cv"))


def top(x: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order that has no ties."""
    return x.orderBy(*order).limit(k)
