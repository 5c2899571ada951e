"""The catalogue: a query for each operator, over inputs derived from the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from fringework.functions import axes, bits, cplx
from fringework.operators import contract, decode, dedisp, imaging, layout, linalg, reduce, search, weights as steer
from fringework.plans import pipelines
from fringework.queries.registry import BEAMS, CELLS, DD, DELAYS, FB, GEO, GRID, MAT, TRI, VOLT, WEIGHTS, query
from fringework.sources import fixtures as fx, packets
from fringework.streaming import blocks, sources

LOW, HIGH, DT, N_CHAN, N_TIME, N_DM, MOST_DM = 1.2, 1.6, 0.001, 16, 64, 8, 40.0
WIDTHS, MEAN, SIGMA = (1, 2, 4, 8), 0.0, 4000.0
N_GRID, CELL = 64, 20.0


def _volt(spark, d):
    return decode.decode(fx.voltage(spark, d))


def _tri(spark, d):
    return contract.correlate(decode.split_time(_volt(spark, d), 2))


def _beams(spark, d, conjugate=False):
    return contract.beamform(_volt(spark, d), fx.weights(spark), conjugate)


def _ps(spark, d):
    return reduce.power_sum(_beams(spark, d), reduce.incoherent_beam(_volt(spark, d), fx.flags(spark)), 4)


def _dms(spark):
    return dedisp.trials(spark, N_DM, 0.0, MOST_DM)


def _shifts(spark):
    return dedisp.delays(_dms(spark), N_CHAN, LOW, HIGH, DT)


def _dd(spark, d):
    return dedisp.shifted_sum(fx.filterbank(spark, d), _shifts(spark), N_TIME)


def _freqs(spark):
    return steer.channels(spark, fx.CHAN).withColumnRenamed("fq", "chan")


def _grid(spark, d):
    vis = reduce.pol_reduce(_tri(spark, d), ("chan",))
    return imaging.grid(vis, imaging.cells(fx.baselines(spark), _freqs(spark), CELL, N_GRID), N_GRID)


def _r(c: str, places: int = 6):
    return (F.round(F.col(c).cast("double"), places) + 0.0).alias(c)


# ---- decoding and packing


@query(f"WITH {VOLT} SELECT t, chan, ant, pol, re, im FROM sm")
def qc_decode_sm(spark: SparkSession, d: str) -> DataFrame:
    return _volt(spark, d).select("t", "chan", "ant", "pol", "re", "im")


@query(f"WITH {VOLT} SELECT t, chan, ant, pol, CAST(CASE WHEN (byte & 15) > 7 THEN (byte & 15) - 16 ELSE byte & 15 END AS BIGINT) AS re, CAST(CASE WHEN (byte >> 4) > 7 THEN (byte >> 4) - 16 ELSE byte >> 4 END AS BIGINT) AS im FROM volt")
def nibble_decode_tc(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode(fx.voltage(spark, d), "twos").select("t", "chan", "ant", "pol", "re", "im")


@query(f"WITH {VOLT} SELECT t, chan, ant, pol, 0.05::DOUBLE * CAST(CASE WHEN (byte & 15) > 7 THEN (byte & 15) - 16 ELSE byte & 15 END AS BIGINT) AS re, 0.05::DOUBLE * CAST(CASE WHEN (byte >> 4) > 7 THEN (byte >> 4) - 16 ELSE byte >> 4 END AS BIGINT) AS im FROM volt")
def nibble_decode_scaled(spark: SparkSession, d: str) -> DataFrame:
    v = decode.decode(fx.voltage(spark, d), "twos")
    return v.select("t", "chan", "ant", "pol", (F.lit(0.05) * F.col("re")).alias("re"), (F.lit(0.05) * F.col("im")).alias("im"))


@query(f"WITH {VOLT} SELECT t, chan, ant, pol, CAST(((im & 15) << 4) | (re & 15) AS BIGINT) AS packed FROM sm")
def qc_repack(spark: SparkSession, d: str) -> DataFrame:
    return fx.voltage(spark, d).select("t", "chan", "ant", "pol", bits.repack(F.col("byte")).cast("bigint").alias("packed"))


@query(f"WITH {VOLT}, f AS (SELECT t, chan, ant, pol, re, im, CASE abs(re) WHEN 5 THEN 4 WHEN 7 THEN 8 ELSE abs(re) END AS a, CASE abs(im) WHEN 5 THEN 4 WHEN 7 THEN 8 ELSE abs(im) END AS b FROM sm) SELECT t, chan, ant, pol, CAST(sign(re) * a AS BIGINT) AS re, CAST(sign(im) * b AS BIGINT) AS im FROM f")
def fp4_round(spark: SparkSession, d: str) -> DataFrame:
    v = _volt(spark, d)
    return v.select("t", "chan", "ant", "pol", bits.fp4(F.col("re")).cast("bigint").alias("re"), bits.fp4(F.col("im")).cast("bigint").alias("im"))


@query("SELECT event_id, greatest(least(value * 10 - 2000, 448.0), -448.0) AS x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS single FROM events")
def saturate_cast(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.select("event_id", bits.saturate(F.col("value") * 10 - 2000).alias("x"), F.col("value").cast("float").cast("double").alias("single"))


@query("SELECT event_id, event_id // (4 * 8 * 2 * 2) AS t_outer, (event_id // 32) % 4 AS ant, (event_id // 4) % 8 AS chan, (event_id // 2) % 2 AS t_inner, event_id % 2 AS pol FROM events")
def packet_decode_dsa110(spark: SparkSession, d: str) -> DataFrame:
    at = packets.coordinates(F.col("event_id"), "dsa110", {"ant": 4, "chan": 8, "t_inner": 2, "pol": 2})
    return fx.table(spark, d, "events").select("event_id", *[c.alias(a) for a, c in at.items()])


@query("SELECT event_id, event_id // 512 AS chan, (event_id // 256) % 2 AS pol, (event_id // 128) % 2 AS t_inner, (event_id // 8) % 16 AS k, event_id % 8 AS ant FROM events")
def packet_decode_gemm(spark: SparkSession, d: str) -> DataFrame:
    at = packets.coordinates(F.col("event_id"), "gemm", {"pol": 2, "t_inner": 2, "k": 16, "ant": 8})
    return fx.table(spark, d, "events").select("event_id", *[c.alias(a) for a, c in at.items()])


@query("SELECT event_id, event_id // 64 AS t, (event_id // 8) % 8 AS ant, (event_id // 2) % 4 AS chan, event_id % 2 AS pol FROM events")
def packet_decode_tcc(spark: SparkSession, d: str) -> DataFrame:
    at = packets.coordinates(F.col("event_id"), "tcc", {"ant": 8, "chan": 4, "pol": 2})
    return fx.table(spark, d, "events").select("event_id", *[c.alias(a) for a, c in at.items()])


@query("WITH x AS (SELECT event_id, event_id // 64 AS t, (event_id // 8) % 8 AS ant, (event_id // 2) % 4 AS chan, event_id % 2 AS pol FROM events) SELECT event_id, ((chan * 2 + pol) * 8 + ant) * 1000000 + t AS index FROM x")
def layout_reorder(spark: SparkSession, d: str) -> DataFrame:
    """From one payload order to another, by way of the axes."""
    at = packets.coordinates(F.col("event_id"), "tcc", {"ant": 8, "chan": 4, "pol": 2})
    x = fx.table(spark, d, "events").select("event_id", *[c.alias(a) for a, c in at.items()])
    return x.select("event_id", packets.flat_index("qc", {"pol": 2, "ant": 8, "t": 1000000}).alias("index"))


@query("SELECT id AS index, CAST(((id * 1103515245 + 42 * 12345) % 2147483648) // 65536 % 256 AS INTEGER) AS byte, id // 16 AS t, (id // 4) % 4 AS ant, (id // 2) % 2 AS chan, id % 2 AS pol FROM range(4096) r(id)")
def random_voltage(spark: SparkSession, d: str) -> DataFrame:
    return packets.random_voltage(spark, 4096, "tcc", {"ant": 4, "chan": 2, "pol": 2})


@query(f"WITH {VOLT} SELECT t, chan, ant, pol, CAST(t // 16 AS INTEGER) AS t_inner, t % 16 AS k FROM volt")
def time_split_blocked(spark: SparkSession, d: str) -> DataFrame:
    return decode.split_time(fx.voltage(spark, d), 1, blocked=16).select("t", "chan", "ant", "pol", "t_inner", "k")


@query(f"WITH {VOLT} SELECT t, chan, ant, pol, CAST(t % 2 AS INTEGER) AS t_inner, t // 2 AS k FROM volt")
def time_split_interleaved(spark: SparkSession, d: str) -> DataFrame:
    return decode.split_time(fx.voltage(spark, d), 2).select("t", "chan", "ant", "pol", "t_inner", "k")


# ---- correlation


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, CAST(ant_i * (ant_i + 1) // 2 + ant_j AS BIGINT) AS bl, re, im FROM tri")
def xengine_tri(spark: SparkSession, d: str) -> DataFrame:
    return layout.with_lower_index(_tri(spark, d))


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, re, im FROM tri")
def xengine_tri_block(spark: SparkSession, d: str) -> DataFrame:
    return contract.correlate(decode.split_time(_volt(spark, d), 2), form="block")


@query(f"WITH {VOLT} SELECT i.chan, i.pol, CAST(i.t % 2 AS INTEGER) AS t_inner, i.ant AS ant_i, j.ant AS ant_j, CAST(sum(i.re * j.re + i.im * j.im) AS BIGINT) AS re, CAST(sum(i.re * j.im - i.im * j.re) AS BIGINT) AS im FROM sm i JOIN sm j ON i.chan = j.chan AND i.pol = j.pol AND i.t = j.t GROUP BY ALL")
def xengine_herm(spark: SparkSession, d: str) -> DataFrame:
    """The whole matrix conj(A)^T A: the triangle mirrored, and its conjugate."""
    return layout.transposed(layout.full(_tri(spark, d), ("chan", "pol", "t_inner")))


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, re, im FROM tri UNION ALL SELECT chan, pol, t_inner, ant_j, ant_i, re, -im FROM tri WHERE ant_i <> ant_j")
def tri_to_herm(spark: SparkSession, d: str) -> DataFrame:
    return layout.full(_tri(spark, d), ("chan", "pol", "t_inner"))


@query(f"WITH {TRI}, h AS (SELECT chan, pol, t_inner, ant_i, ant_j, re, im FROM tri UNION ALL SELECT chan, pol, t_inner, ant_j, ant_i, re, -im FROM tri WHERE ant_i <> ant_j) SELECT chan, pol, t_inner, ant_i, ant_j, re, im, CAST(ant_i * 8 + ant_j - ant_i * (ant_i + 1) // 2 AS BIGINT) AS tri FROM h WHERE ant_j >= ant_i")
def herm_to_upper(spark: SparkSession, d: str) -> DataFrame:
    return layout.upper(layout.full(_tri(spark, d), ("chan", "pol", "t_inner")), fx.ANT)


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, re, im FROM tri")
def herm_to_lower(spark: SparkSession, d: str) -> DataFrame:
    return layout.lower(layout.full(_tri(spark, d), ("chan", "pol", "t_inner")))


@query(f"WITH {TRI}, h AS (SELECT chan, pol, t_inner, ant_i, ant_j, re, im FROM tri UNION ALL SELECT chan, pol, t_inner, ant_j, ant_i, re, -im FROM tri WHERE ant_i <> ant_j) SELECT a.chan, a.pol, a.t_inner, a.ant_i, a.ant_j, (a.re - b.re) / 2 AS re, (a.im - b.im) / 2 AS im FROM h a JOIN h b ON a.chan = b.chan AND a.pol = b.pol AND a.t_inner = b.t_inner AND a.ant_i = b.ant_j AND a.ant_j = b.ant_i")
def herm_antisymmetric(spark: SparkSession, d: str) -> DataFrame:
    k = ("chan", "pol", "t_inner")
    return layout.antisymmetric(layout.full(_tri(spark, d), k), k)


@query("SELECT id AS k, CAST(r.row AS BIGINT) AS row, id - r.row * (r.row + 1) // 2 AS col FROM range(5000) s(id) JOIN (SELECT range AS row FROM range(200)) r ON id >= r.row * (r.row + 1) // 2 AND id < (r.row + 1) * (r.row + 2) // 2")
def tri_index(spark: SparkSession, d: str) -> DataFrame:
    k = spark.range(5000).select(F.col("id").alias("k")).withColumn("row", axes.lower_row(F.col("k")))
    return k.select("k", "row", (F.col("k") - axes.lower_index(F.col("row"), F.lit(0))).alias("col"))


@query(f"WITH {TRI} SELECT chan, t_inner, ant_i, ant_j, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM tri GROUP BY ALL")
def pol_reduce(spark: SparkSession, d: str) -> DataFrame:
    return reduce.pol_reduce(_tri(spark, d))


@query(f"WITH {VOLT} SELECT i.chan, i.ant AS ant_i, j.ant AS ant_j, i.pol AS pol_i, j.pol AS pol_j, CAST(sum(i.re * j.re + i.im * j.im) AS BIGINT) AS re, CAST(sum(i.im * j.re - i.re * j.im) AS BIGINT) AS im FROM sm i JOIN sm j ON i.chan = j.chan AND i.t = j.t AND j.ant <= i.ant AND j.pol <> i.pol GROUP BY ALL")
def xengine_crosspol(spark: SparkSession, d: str) -> DataFrame:
    return contract.cross_polar(_volt(spark, d))


@query(f"WITH {VOLT} SELECT i.chan, i.ant AS ant_i, j.ant AS ant_j, i.pol AS pol_i, j.pol AS pol_j, CAST(sum(i.re * j.re + i.im * j.im) AS BIGINT) AS re, CAST(sum(i.im * j.re - i.re * j.im) AS BIGINT) AS im FROM sm i JOIN sm j ON i.chan = j.chan AND i.t = j.t AND j.ant <= i.ant AND j.pol <> i.pol GROUP BY ALL")
def xengine_crosspol_block(spark: SparkSession, d: str) -> DataFrame:
    return contract.cross_polar(_volt(spark, d), form="block")


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, CAST(2 * re + CASE WHEN t_inner = 0 THEN 3 * sum(re) OVER w ELSE 0 END AS BIGINT) AS re, CAST(2 * im + CASE WHEN t_inner = 0 THEN 3 * sum(im) OVER w ELSE 0 END AS BIGINT) AS im FROM tri WINDOW w AS (PARTITION BY chan, pol, ant_i, ant_j)")
def herk_accumulate(spark: SparkSession, d: str) -> DataFrame:
    """Twice the sums at both inner times, and three times the sum of all, which has the first one's key."""
    whole = contract.correlate(decode.split_time(_volt(spark, d), 1))
    return contract.accumulate(_tri(spark, d), whole, ("chan", "pol", "t_inner", "ant_i", "ant_j"), 2, 3)


@query(f"WITH {TRI} SELECT CAST(((ant_i * (ant_i + 1) // 2 + ant_j) * 7) % 36 AS BIGINT) AS out, CAST(chan // 4 AS INTEGER) AS chan, CAST(t_inner // 2 AS BIGINT) AS t, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM tri GROUP BY ALL")
def baseline_lookup(spark: SparkSession, d: str) -> DataFrame:
    vis = layout.with_lower_index(_tri(spark, d)).withColumnRenamed("t_inner", "t")
    lookup = spark.range(36).select(F.col("id").alias("bl"), (F.col("id") * 7 % 36).alias("out"))
    return layout.fold_baselines(vis, lookup)


# ---- matrix products


def _gemm_sql(a: str, b: str, on: str, i: str, j: str, conj_a: int = 1, conj_b: int = 1) -> str:
    return f"SELECT {a}.b, {i} AS i, {j} AS j, CAST(sum(x.re * y.re - {conj_a * conj_b} * x.im * y.im) AS BIGINT) AS re, CAST(sum({conj_b} * x.re * y.im + {conj_a} * x.im * y.re) AS BIGINT) AS im FROM mat x JOIN mat y ON {on} GROUP BY ALL"


_NN = _gemm_sql("x", "y", "x.b = y.b AND x.k = y.i", "x.i", "y.k")


def _right(m):
    return m.select("b", F.col("i").alias("k"), F.col("k").alias("j"), "re", "im")


@query(f"WITH {MAT}, p AS ({_NN}) SELECT p.b, p.i, p.j, CAST(p.re - 2 * p.im - 3 * c.re - 2 * c.im AS BIGINT) AS re, CAST(2 * p.re + p.im - 3 * c.im + 2 * c.re AS BIGINT) AS im FROM p JOIN mat c ON p.b = c.b AND p.i = c.i AND p.j = c.k")
def gemm_batched(spark: SparkSession, d: str) -> DataFrame:
    """(1 + 2i) A B + (-3 + 2i) C."""
    m = fx.matrices(spark, d)
    return contract.gemm(m, _right(m), alpha=1 + 2j, beta=-3 + 2j, c=m.withColumnRenamed("k", "j"))


@query(f"WITH {MAT} {_gemm_sql('x', 'y', 'x.b = y.b AND x.i = y.k', 'x.k', 'y.i', 1, -1)}")
def gemm_trans_conj(spark: SparkSession, d: str) -> DataFrame:
    """A^T B^H."""
    m = fx.matrices(spark, d)
    return contract.gemm(m, _right(m), "T", "C")


@query(f"WITH {MAT} {_gemm_sql('x', 'y', 'x.b = y.b AND x.i = y.k', 'x.k', 'y.i', 1, -1)}")
def gemm_block(spark: SparkSession, d: str) -> DataFrame:
    """A^T B^H by tiles."""
    m = fx.matrices(spark, d)
    return contract.gemm(m, _right(m), "T", "C", form="block")


@query(f"WITH {MAT} {_gemm_sql('x', 'y', 'x.b = y.b AND x.i = y.i', 'x.k', 'y.k', -1, 1)}")
def gemm_conj(spark: SparkSession, d: str) -> DataFrame:
    """A^H B."""
    m = fx.matrices(spark, d)
    return contract.gemm(m, _right(m), "C", "N")


@query(f"WITH {MAT} {_gemm_sql('x', 'y', 'y.b = 0 AND x.k = y.i', 'x.i', 'y.k')}")
def gemm_broadcast_b(spark: SparkSession, d: str) -> DataFrame:
    m = fx.matrices(spark, d)
    return contract.gemm(m, _right(m.where("b = 0")).drop("b"), most_rows_sent=100_000)


@query(f"WITH {MAT} {_gemm_sql('x', 'y', 'y.b = 0 AND x.k = y.i', 'x.i', 'y.k')}")
def gemm_shared_block(spark: SparkSession, d: str) -> DataFrame:
    m = fx.matrices(spark, d)
    return contract.gemm(m, _right(m.where("b = 0")).drop("b"), form="block")


@query(f"WITH {MAT}, p AS ({_gemm_sql('x', 'y', 'x.b = y.b AND x.k = y.k', 'x.i', 'y.i')}) SELECT p.b, p.i, p.j, CAST(2 * (p.re * p.re + p.im * p.im) + 3 * c.re AS BIGINT) AS value FROM p JOIN mat c ON p.b = c.b AND p.i = c.i AND p.j = c.k")
def power_gemm(spark: SparkSession, d: str) -> DataFrame:
    """2 |A B^T|^2 + 3 P."""
    m = fx.matrices(spark, d)
    p = m.select("b", "i", F.col("k").alias("j"), F.col("re").alias("value"))
    return contract.power_gemm(m, _right(m), 2, 3, p, op_b="T")


@query(f"WITH {MAT}, p AS ({_gemm_sql('x', 'y', 'x.b = y.b AND x.k = y.k', 'x.i', 'y.i')}) SELECT p.b, p.i, p.j, CAST(2 * (p.re * p.re + p.im * p.im) + 3 * c.re AS BIGINT) AS value FROM p JOIN mat c ON p.b = c.b AND p.i = c.i AND p.j = c.k")
def power_gemm_block(spark: SparkSession, d: str) -> DataFrame:
    m = fx.matrices(spark, d)
    p = m.select("b", "i", F.col("k").alias("j"), F.col("re").alias("value"))
    return contract.power_gemm(m, _right(m), 2, 3, p, op_b="T", form="block")


@query(f"WITH {MAT} SELECT b, i, k AS j, CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS re, 0.0::DOUBLE AS im FROM mat")
def lu_inverse(spark: SparkSession, d: str) -> DataFrame:
    """A (made regular by its diagonal) times its inverse is the unit matrix."""
    m = fx.matrices(spark, d).withColumn("re", F.col("re") + F.when(F.col("i") == F.col("k"), 2000).otherwise(0))
    one = contract.gemm(m, linalg.inverse(m).select("b", F.col("i").alias("k"), F.col("k").alias("j"), "re", "im"))
    return one.select("b", "i", "j", _r("re"), _r("im"))


# ---- beams


@query(f"WITH {BEAMS} SELECT chan, pol, t, beam, re, im FROM z")
def voltage_beamform(spark: SparkSession, d: str) -> DataFrame:
    return _beams(spark, d)


@query(f"WITH {BEAMS} SELECT chan, pol, t, beam, re, im FROM z")
def voltage_beamform_block(spark: SparkSession, d: str) -> DataFrame:
    return contract.beamform(_volt(spark, d), fx.weights(spark), form="block")


@query(f"WITH {VOLT}, {WEIGHTS} SELECT chan, pol, t, beam, CAST(sum(wre * re + wim * im) AS BIGINT) AS re, CAST(sum(wim * re - wre * im) AS BIGINT) AS im FROM sm JOIN w USING (chan, ant) GROUP BY ALL")
def voltage_beamform_conj(spark: SparkSession, d: str) -> DataFrame:
    return _beams(spark, d, True)


@query(f"WITH {VOLT}, {WEIGHTS} SELECT chan, pol, t, CAST(ant // 4 AS INTEGER) AS arm, beam, CAST(sum(wre * re - wim * im) AS BIGINT) AS re, CAST(sum(wre * im + wim * re) AS BIGINT) AS im FROM sm JOIN w USING (chan, ant) GROUP BY ALL")
def beamform_by_arm(spark: SparkSession, d: str) -> DataFrame:
    return contract.beamform_by_arm(_volt(spark, d), fx.weights(spark), fx.ANT)


@query(f"WITH {BEAMS} SELECT chan, t, ib FROM ib")
def incoherent_beam(spark: SparkSession, d: str) -> DataFrame:
    return reduce.incoherent_beam(_volt(spark, d), fx.flags(spark))


@query(f"WITH {BEAMS} SELECT chan, beam, t, value FROM ps")
def power_sum_ib(spark: SparkSession, d: str) -> DataFrame:
    return _ps(spark, d)


_INNER = "SELECT beam, CAST(chan // 2 AS INTEGER) AS chan, t // 2 AS t, CAST(greatest(least(trunc(sum(value) * 0.001::DOUBLE + {o}), 255), 0) AS INTEGER) AS value FROM ps GROUP BY beam, chan // 2, t // 2"


@query(f"WITH {BEAMS} {_INNER.format(o=70)}")
def inner_sum_u8(spark: SparkSession, d: str) -> DataFrame:
    return reduce.inner_sum(_ps(spark, d), 2, 2, 70, 0.001)


@query(f"WITH {BEAMS} {_INNER.format(o=0)}")
def inner_sum_plain_u8(spark: SparkSession, d: str) -> DataFrame:
    """Without an incoherent beam taken off there is no offset."""
    return reduce.inner_sum(_ps(spark, d), 2, 2, 0, 0.001)


@query(f"WITH {BEAMS} SELECT chan, beam, t // 8 AS t, CAST(sum(value) AS BIGINT) AS value FROM ps GROUP BY 1, 2, 3")
def time_integrate(spark: SparkSession, d: str) -> DataFrame:
    return reduce.integrate(_ps(spark, d), 8)


@query(f"WITH {BEAMS} SELECT chan, beam, t // 4 AS t, CAST(sum(re * re + im * im) AS BIGINT) AS value FROM z GROUP BY 1, 2, 3")
def stokes_i(spark: SparkSession, d: str) -> DataFrame:
    return reduce.stokes_i(_beams(spark, d), 4)


@query(f"WITH {BEAMS} SELECT beam, round(avg(value), 4) + 0.0 AS mean, round(avg((value - 70.0::DOUBLE) * (value - 70.0::DOUBLE)), 2) + 0.0 AS mean_square FROM ps GROUP BY beam")
def beam_moments(spark: SparkSession, d: str) -> DataFrame:
    return reduce.moments(_ps(spark, d)).select("beam", _r("mean", 4), _r("mean_square", 2))


@query(f"WITH {BEAMS} SELECT chan, beam, t // 4 AS t, CAST(greatest(least(round_even(CAST(sum(re * re + im * im) AS DOUBLE) * 0.002::DOUBLE, 0), 255), 0) AS INTEGER) AS value FROM z GROUP BY 1, 2, 3")
def voltage_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.beam_powers(fx.voltage(spark, d), fx.weights(spark), 4, 0.002)


@query(f"WITH {BEAMS} SELECT beam, chan, array_to_string(list(value ORDER BY t), ',') AS samples FROM ps GROUP BY beam, chan")
def corner_turn(spark: SparkSession, d: str) -> DataFrame:
    turned = layout.corner_turn(_ps(spark, d), "value")
    return turned.select("beam", "chan", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query(f"WITH {BEAMS} SELECT CAST(beam AS INTEGER) AS beam, chan, t, value FROM (SELECT beam, chan, row_number() OVER (PARTITION BY beam, chan ORDER BY t) - 1 AS t, value FROM ps)")
def corner_turn_back(spark: SparkSession, d: str) -> DataFrame:
    return layout.unfold(layout.corner_turn(_ps(spark, d), "value"), "value").select("beam", "chan", F.col("t").cast("bigint").alias("t"), "value")


# ---- quantisers, on values with ties


_X = "WITH q AS (SELECT event_id, CAST(floor(value * 2) AS BIGINT) / 2 - 100 AS x FROM events)"


def _ties(spark, d):
    return fx.table(spark, d, "events").select("event_id", (F.floor(F.col("value") * 2).cast("double") / 2 - 100).alias("x"))


@query(f"{_X} SELECT event_id, CAST(greatest(least(round_even(x, 0), 255), 0) AS INTEGER) AS q FROM q")
def quantise_rint(spark: SparkSession, d: str) -> DataFrame:
    return _ties(spark, d).select("event_id", bits.quantise_even(F.col("x")).alias("q"))


@query(f"{_X} SELECT event_id, CAST(floor(greatest(least(x, 255.0::DOUBLE), 0.0::DOUBLE) + 0.5) AS INTEGER) AS q FROM q")
def quantise_half_up(spark: SparkSession, d: str) -> DataFrame:
    return _ties(spark, d).select("event_id", bits.quantise_half_up(F.col("x")).alias("q"))


@query(f"{_X} SELECT event_id, CAST(greatest(least(sign(x) * floor(abs(x) + 0.5), 255), 0) AS INTEGER) AS q FROM q")
def quantise_half_away(spark: SparkSession, d: str) -> DataFrame:
    return _ties(spark, d).select("event_id", bits.quantise_half_away(F.col("x")).alias("q"))


@query(f"{_X} SELECT event_id, CAST(greatest(least(trunc(x), 255), 0) AS INTEGER) AS q FROM q")
def quantise_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _ties(spark, d).select("event_id", bits.quantise_truncate(F.col("x")).alias("q"))


@query(f"{_X} SELECT event_id, CAST(greatest(least(sign(x + 127.5::DOUBLE) * floor(abs(x + 127.5::DOUBLE) + 0.5), 255), 0) AS INTEGER) AS q FROM q")
def quantise_offset127(spark: SparkSession, d: str) -> DataFrame:
    return _ties(spark, d).select("event_id", bits.quantise_zero_mean(F.col("x")).alias("q"))


# ---- reductions


_V = f"WITH {VOLT}, v AS (SELECT chan AS batch, t * 16 + pol * 8 + ant AS i, re, im FROM sm)"


def _vectors(spark, d):
    return _volt(spark, d).select(F.col("chan").alias("batch"), (F.col("t") * 16 + F.col("pol") * 8 + F.col("ant")).alias("i"), "re", "im")


@query(f"{_V} SELECT batch, CAST(sum(re) AS BIGINT) AS value FROM v GROUP BY batch")
def reduce_plus(spark: SparkSession, d: str) -> DataFrame:
    return reduce.transform_reduce(_vectors(spark, d))


@query(f"{_V} SELECT batch, CAST(sum(re * re + im * im) AS BIGINT) AS value FROM v GROUP BY batch")
def reduce_square(spark: SparkSession, d: str) -> DataFrame:
    return reduce.transform_reduce(_vectors(spark, d), "plus", "square")


@query(f"{_V} SELECT batch, round(sum(sqrt(CAST(re * re + im * im AS DOUBLE))), 4) AS value FROM v GROUP BY batch")
def reduce_abs(spark: SparkSession, d: str) -> DataFrame:
    return reduce.transform_reduce(_vectors(spark, d), "plus", "abs").select("batch", _r("value", 4))


@query(f"{_V} SELECT batch, max(greatest(abs(re), abs(im))) AS value FROM v GROUP BY batch")
def reduce_absmax(spark: SparkSession, d: str) -> DataFrame:
    return reduce.transform_reduce(_vectors(spark, d), "max", "abs_max")


@query(f"{_V} SELECT batch, min(least(abs(re), abs(im))) AS value FROM v GROUP BY batch")
def reduce_absmin(spark: SparkSession, d: str) -> DataFrame:
    return reduce.transform_reduce(_vectors(spark, d), "min", "abs_min")


@query(f"{_V} SELECT batch, round(sum((re * re + im * im) * (0.05::DOUBLE * 0.05::DOUBLE)), 6) AS value FROM v GROUP BY batch")
def reduce_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    return reduce.transform_reduce(_vectors(spark, d), "plus", "square", scale=0.05).select("batch", _r("value"))


@query(f"{_V} SELECT batch, CAST(sum(re * re + im * im) AS BIGINT) AS value FROM v WHERE (i // 8) % 4 = 1 GROUP BY batch")
def strided_subset_reduce(spark: SparkSession, d: str) -> DataFrame:
    return reduce.transform_reduce(_vectors(spark, d), "plus", "square", subset=reduce.strided("i", 8, 4, 1))


@query(f"{_V} SELECT CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM v")
def vector_reduce(spark: SparkSession, d: str) -> DataFrame:
    return reduce.vector_reduce(_vectors(spark, d))


@query(f"WITH {VOLT} SELECT chan, CAST(sum(byte) AS BIGINT) AS total, max(byte) AS most, min(byte) AS least, bit_xor(byte) AS parity FROM volt GROUP BY chan")
def all_reduce(spark: SparkSession, d: str) -> DataFrame:
    return reduce.all_reduce(fx.voltage(spark, d), "byte", ("chan",))


@query("SELECT event_id, value * 0.25::DOUBLE AS value FROM events")
def scale_vector(spark: SparkSession, d: str) -> DataFrame:
    return reduce.scale_vector(fx.table(spark, d, "events").select("event_id", "value"), 0.25)


@query("SELECT k AS event_id, round(sum(v), 6) AS value FROM (SELECT event_id AS k, 2.0::DOUBLE * value AS v FROM events UNION ALL SELECT o_orderkey, -0.5::DOUBLE * o_totalprice FROM orders) GROUP BY k")
def axpby(spark: SparkSession, d: str) -> DataFrame:
    """Either operand has keys that the other one lacks."""
    e = fx.table(spark, d, "events").select("event_id", "value")
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("value"))
    return reduce.axpby(e, o, 2.0, -0.5, ("event_id",)).select("event_id", _r("value"))


@query(f"WITH {FB} SELECT beam, max(greatest(abs(x), abs(x * 2 - 5))) AS most, round(448.0::DOUBLE / max(greatest(abs(x), abs(x * 2 - 5))), 9) AS scale FROM fb GROUP BY beam")
def global_absmax(spark: SparkSession, d: str) -> DataFrame:
    z = fx.filterbank(spark, d).select("beam", F.col("x").alias("re"), (F.col("x") * 2 - 5).alias("im"))
    return reduce.absolute_max(z, ("beam",)).select("beam", "most", _r("scale", 9))


@query(f"WITH {FB} SELECT beam, chan, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS sigma FROM fb GROUP BY beam, chan")
def sample_stats(spark: SparkSession, d: str) -> DataFrame:
    return reduce.sample_stats(fx.filterbank(spark, d), ("beam", "chan")).select("beam", "chan", _r("mean"), _r("sigma"))


_CLIP = "SELECT beam, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS s FROM {t} GROUP BY beam"
_KEEP = "SELECT beam, x FROM {t} JOIN {l} USING (beam) WHERE s < 1e-9 OR abs(x - m) <= 3.0::DOUBLE * s"


@query(f"WITH {FB}, c0 AS (SELECT beam, CAST(x * x * x AS DOUBLE) / 1e6 AS x FROM fb), l0 AS ({_CLIP.format(t='c0')}), c1 AS ({_KEEP.format(t='c0', l='l0')}), l1 AS ({_CLIP.format(t='c1')}), c2 AS ({_KEEP.format(t='c1', l='l1')}), l2 AS ({_CLIP.format(t='c2')}) SELECT beam, round(m, 5) + 0.0 AS mean, round(s, 5) AS sigma FROM l2")
def robust_stats(spark: SparkSession, d: str) -> DataFrame:
    """Of cubes, which have outliers."""
    x = fx.filterbank(spark, d).select("beam", ((F.col("x") * F.col("x") * F.col("x")).cast("double") / 1e6).alias("x"))
    return reduce.robust(x, ("beam",)).select("beam", _r("mean", 5), _r("sigma", 5))


@query(f"WITH {TRI} SELECT round(sqrt(sum(e)), 6) AS frobenius, round(sqrt(sum(e) / sum(p)), 9) AS relative, round(sqrt(sum(e) / count(*)), 6) AS rms, round(10 * log10(sum(p) / sum(e)), 6) AS snr_db FROM (SELECT CAST(CASE WHEN ant_i = 3 THEN 4 ELSE 0 END AS DOUBLE) AS e, CAST(re * re + im * im AS DOUBLE) AS p FROM tri)")
def error_measures(spark: SparkSession, d: str) -> DataFrame:
    k = ("chan", "pol", "t_inner", "ant_i", "ant_j")
    tri = _tri(spark, d)
    off = tri.withColumn("re", F.col("re") + F.when(F.col("ant_i") == 3, 2).otherwise(0))
    return reduce.deviation(off, tri, k).select(_r("frobenius"), _r("relative", 9), _r("rms"), _r("snr_db"))


@query(f"WITH {TRI} SELECT chan, round(avg(sqrt(CAST(re * re + im * im AS DOUBLE))), 6) AS mean, round(stddev_pop(sqrt(CAST(re * re + im * im AS DOUBLE))) / avg(sqrt(CAST(re * re + im * im AS DOUBLE))), 6) AS cv FROM tri GROUP BY chan")
def image_stats(spark: SparkSession, d: str) -> DataFrame:
    return reduce.image_stats(_tri(spark, d)).select("chan", _r("mean"), _r("cv"))


@query(f"WITH {VOLT} SELECT t, chan, ant, pol, re, im FROM sm WHERE t >= 3 AND t < 7")
def inspect_elements(spark: SparkSession, d: str) -> DataFrame:
    return layout.inspect(_volt(spark, d), "t", 3, 7).select("t", "chan", "ant", "pol", "re", "im")


@query(f"WITH {BEAMS} SELECT beam, chan, t, value FROM ps ORDER BY value DESC, beam, chan, t LIMIT 20")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    return reduce.top(_ps(spark, d).select("beam", "chan", "t", "value"), 20, F.desc("value"), F.asc("beam"), F.asc("chan"), F.asc("t"))


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, CAST(0 AS INTEGER) AS part, re AS value FROM tri UNION ALL SELECT chan, pol, t_inner, ant_i, ant_j, 1, im FROM tri")
def interleave_tri(spark: SparkSession, d: str) -> DataFrame:
    return layout.interleave(_tri(spark, d), ("chan", "pol", "t_inner", "ant_i", "ant_j"))


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, re, im FROM tri")
def deinterleave_tri(spark: SparkSession, d: str) -> DataFrame:
    k = ("chan", "pol", "t_inner", "ant_i", "ant_j")
    return layout.deinterleave(layout.interleave(_tri(spark, d), k), k)


# ---- complex functions


_Z = "WITH z AS (SELECT event_id, value / 200 + 0.1 AS x, (event_id % 17) / 10.0::DOUBLE - 0.75 AS y FROM events)"


@query(f"""{_Z} SELECT event_id, round(x * 0.5 - y * 1.5, 6) + 0.0 AS mul_re, round(x * 1.5 + y * 0.5, 6) + 0.0 AS mul_im,
  round((x * 0.5 + y * 1.5) / 2.5, 6) + 0.0 AS div_re, round((y * 0.5 - x * 1.5) / 2.5, 6) + 0.0 AS div_im, round(sqrt(x * x + y * y), 6) AS abs, round(atan2(y, x), 6) + 0.0 AS arg, round(x * x + y * y, 6) AS norm,
  round(exp(x) * cos(y), 6) + 0.0 AS exp_re, round(exp(x) * sin(y), 6) + 0.0 AS exp_im, round(ln(sqrt(x * x + y * y)), 6) + 0.0 AS log_re, round(ln(sqrt(x * x + y * y)) / ln(10), 6) + 0.0 AS log10_re,
  round(sqrt((sqrt(x * x + y * y) + x) / 2), 6) AS sqrt_re, round(sign(y) * sqrt((sqrt(x * x + y * y) - x) / 2), 6) + 0.0 AS sqrt_im,
  round(sin(x) * cosh(y), 6) + 0.0 AS sin_re, round(cos(x) * cosh(y), 6) + 0.0 AS cos_re, round(sinh(x) * cos(y), 6) + 0.0 AS sinh_re, round(cosh(x) * cos(y), 6) + 0.0 AS cosh_re,
  round(sin(2 * x) / (cos(2 * x) + cosh(2 * y)), 5) + 0.0 AS tan_re, round(sinh(2 * x) / (cosh(2 * x) + cos(2 * y)), 5) + 0.0 AS tanh_re,
  round(0.25 * ln(((1 + x) * (1 + x) + y * y) / ((1 - x) * (1 - x) + y * y)), 5) + 0.0 AS atanh_re, round(exp(0.5 * ln(sqrt(x * x + y * y)) - 0.25 * atan2(y, x)) * cos(0.25 * ln(sqrt(x * x + y * y)) + 0.5 * atan2(y, x)), 5) + 0.0 AS pow_re FROM z""")
def complex_functions(spark: SparkSession, d: str) -> DataFrame:
    z = fx.table(spark, d, "events").select("event_id", (F.col("value") / 200 + 0.1).alias("re"), ((F.col("event_id") % 17) / 10.0 - 0.75).alias("im"))
    a, b, h = cplx.of("re", "im"), cplx.C(F.lit(0.5), F.lit(1.5)), cplx.C(F.lit(0.5), F.lit(0.25))
    out = {
        "mul_re": (a * b).re, "mul_im": (a * b).im, "div_re": (a / b).re, "div_im": (a / b).im, "abs": a.abs(), "arg": a.arg(), "norm": a.norm(), "exp_re": a.exp().re, "exp_im": a.exp().im, "log_re": a.log().re,
        "log10_re": a.log10().re, "sqrt_re": a.sqrt().re, "sqrt_im": a.sqrt().im, "sin_re": a.sin().re, "cos_re": a.cos().re, "sinh_re": a.sinh().re, "cosh_re": a.cosh().re,
    }
    five = {"tan_re": a.tan().re, "tanh_re": a.tanh().re, "atanh_re": a.atanh().re, "pow_re": a.pow(h).re}
    return z.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in out.items()], *[(F.round(c, 5) + 0.0).alias(n) for n, c in five.items()])


# ---- weights


@query(f"WITH {GEO} SELECT ant, fq, pol, round(CASE WHEN ant % 5 = 3 THEN 0 WHEN n > 0 THEN re / n ELSE re END, 6) + 0.0 AS re, round(CASE WHEN ant % 5 = 3 THEN 0 WHEN n > 0 THEN im / n ELSE im END, 6) + 0.0 AS im FROM (SELECT *, sqrt(re * re + im * im) AS n FROM cal)")
def calib_normalise(spark: SparkSession, d: str) -> DataFrame:
    return steer.normalised(fx.calibration(spark), fx.flags(spark)).select("ant", "fq", "pol", _r("re"), _r("im"))


@query("SELECT CAST(id AS INTEGER) AS fq, 1e6::DOUBLE * (1498.75::DOUBLE - id * 0.244140625::DOUBLE) AS hz FROM range(384) r(id)")
def channel_freqs(spark: SparkSession, d: str) -> DataFrame:
    return steer.channels(spark, 384)


_STEER = "WITH " + GEO + """, ph AS (
  SELECT arm, fq, CAST(bm AS INTEGER) AS beam, ant, pol, re, im, -2.0::DOUBLE * pi() * hz * (CASE WHEN arm = 0 THEN {sep}::DOUBLE * ((127 - bm) * pi() / 10800) * e ELSE sin({ns}::DOUBLE * ((127 - bm) * pi() / 10800) - pi() / 180 * {dec}::DOUBLE) * n END) / 299792458.0::DOUBLE AS a
  FROM cal JOIN g USING (ant) JOIN fr USING (fq), (VALUES (0), (1)) m(arm), range({beams}) r(bm)
) SELECT arm, fq, beam, ant, pol, round(cos(a) * re - sin(a) * im, 6) + 0.0 AS re, round(cos(a) * im + sin(a) * re, 6) + 0.0 AS im FROM ph WHERE {where}"""


def _steered(w):
    return w.select("arm", "fq", "beam", "ant", "pol", _r("re"), _r("im"))


@query(_STEER.format(sep="1.0", ns="0.75", dec="-34.43", beams=64, where="true"))
def steering_weights(spark: SparkSession, d: str) -> DataFrame:
    return _steered(steer.steering(fx.geometry(spark), fx.calibration(spark), steer.channels(spark, fx.CHAN), 64, 37.23 - 71.66))


@query(_STEER.format(sep="1.0", ns="0.75", dec="-34.43", beams=64, where="arm = ant // 4"))
def steering_weights_arm(spark: SparkSession, d: str) -> DataFrame:
    return _steered(steer.steering_by_arm(fx.geometry(spark), fx.calibration(spark), steer.channels(spark, fx.CHAN), 64, 37.23 - 71.66, fx.ANT))


@query(_STEER.format(sep="500.0", ns="140.0", dec="0.0", beams=16, where="true"))
def steering_weights_wide(spark: SparkSession, d: str) -> DataFrame:
    return _steered(steer.steering(fx.geometry(spark), fx.calibration(spark), steer.channels(spark, fx.CHAN), 16, 0.0, sep=500.0, sep_ns=140.0))


# ---- imaging


@query(f"WITH {CELLS} SELECT chan, ant_i, ant_j, iu, iv, ju, jv FROM cell")
def uv_cells(spark: SparkSession, d: str) -> DataFrame:
    return imaging.cells(fx.baselines(spark), _freqs(spark), CELL, N_GRID)


@query(f"WITH {GRID} SELECT chan, iv, iu, re, im FROM grid")
def uv_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


@query(f"WITH {GRID} SELECT chan, iv, iu, round(re * w, 6) + 0.0 AS re, round(im * w, 6) + 0.0 AS im FROM (SELECT *, CASE WHEN iu % 2 = 0 THEN 1.0::DOUBLE / (1 + abs(iv - 32)) ELSE 1.0::DOUBLE END AS w FROM grid)")
def uv_grid_tapered(spark: SparkSession, d: str) -> DataFrame:
    taper = spark.range(N_GRID * N_GRID).select(F.expr("id div 64").alias("iv"), (F.col("id") % 64).alias("iu")).where("iu % 2 = 0").withColumn("w", F.lit(1.0) / (1 + F.abs(F.col("iv") - 32)))
    return imaging.tapered(_grid(spark, d), taper).select("chan", "iv", "iu", _r("re"), _r("im"))


@query(f"WITH {GRID} SELECT chan, beam, round(value, 3) + 0.0 AS value FROM dft")
def beam_intensity_dft(spark: SparkSession, d: str) -> DataFrame:
    return imaging.intensity(_grid(spark, d), fx.pixels(spark), N_GRID).select("chan", "beam", _r("value", 3))


@query(f"WITH {GRID} SELECT chan, beam, round(value, 3) + 0.0 AS value FROM dft")
def beam_intensity_fft(spark: SparkSession, d: str) -> DataFrame:
    return imaging.intensity_fft(_grid(spark, d), fx.pixels(spark), N_GRID).select("chan", "beam", _r("value", 3))


@query(f"WITH {GRID} SELECT chan, beam, CAST(floor(greatest(least(value * 0.01::DOUBLE, 255.0::DOUBLE), 0.0::DOUBLE) + 0.5) AS INTEGER) AS value FROM dft")
def visibility_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.imaged(fx.voltage(spark, d), fx.baselines(spark), _freqs(spark), fx.pixels(spark), N_GRID, CELL, scale=0.01)


@query(f"WITH {GRID} SELECT chan, round(sum(CAST(re * re + im * im AS DOUBLE)) * 4096 / 1e6, 3) AS power FROM grid GROUP BY chan")
def image_plane_power(spark: SparkSession, d: str) -> DataFrame:
    """The power of the whole image is that of the grid, times its cells."""
    z = imaging.image(_grid(spark, d), N_GRID)
    return z.groupBy("chan").agg(F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 1e6, 3).alias("power"))


# ---- dedispersion and search


@query(f"WITH {DELAYS} SELECT dm_idx, dm FROM dm")
def dm_grid(spark: SparkSession, d: str) -> DataFrame:
    return _dms(spark)


@query(f"WITH {DELAYS} SELECT dm_idx, chan, round(tau, 9) + 0.0 AS tau, shift FROM sh")
def dispersion_delays(spark: SparkSession, d: str) -> DataFrame:
    return _shifts(spark).select("dm_idx", "chan", _r("tau", 9), "shift")


@query("SELECT id AS k, id / (128 * 0.001::DOUBLE) AS hz FROM range(65) r(id)")
def bin_freqs(spark: SparkSession, d: str) -> DataFrame:
    padded, bins = axes.padded_length(N_TIME, 0.05, DT)
    return spark.range(bins).select(F.col("id").alias("k"), axes.bin_hz(F.col("id"), padded, DT).alias("hz"))


@query(f"WITH {DD} SELECT beam, dm_idx, t, value FROM dd")
def dedisp_bruteforce(spark: SparkSession, d: str) -> DataFrame:
    return _dd(spark, d)


@query(f"WITH {DD} SELECT beam, dm_idx, t, value FROM dd WHERE t < 64 - (SELECT max(shift) FROM sh)")
def dedisp_complete(spark: SparkSession, d: str) -> DataFrame:
    """Only the times that every channel reaches."""
    return dedisp.shifted_sum(fx.filterbank(spark, d), _shifts(spark), N_TIME, complete=True)


@query(f"WITH {DD} SELECT beam, t // 16 AS block, dm_idx, t, value FROM dd")
def dedisp_blocks(spark: SparkSession, d: str) -> DataFrame:
    return dedisp.dedispersed_blocks(fx.filterbank(spark, d), _shifts(spark), 16)


def _tau(whole: bool) -> np.ndarray:
    dm = np.arange(N_DM) / (N_DM - 1) * MOST_DM
    ghz = dedisp.channel_ghz(np.arange(N_CHAN), N_CHAN, LOW, HIGH)
    tau = axes.DISPERSION * dm[:, None] * (1 / ghz**2 - 1 / HIGH**2)[None]
    return np.floor(tau / DT + 0.5) * DT if whole else tau


@query(f"WITH {DD} SELECT beam, CAST(dm_idx AS INTEGER) AS dm_idx, t, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM (SELECT beam, dm_idx, t FROM (SELECT DISTINCT beam FROM fb), (SELECT dm_idx FROM dm), (SELECT range AS t FROM range(64))) LEFT JOIN dd USING (beam, dm_idx, t)")
def fdd(spark: SparkSession, d: str) -> DataFrame:
    """By phases, with delays of whole samples, so that the sums are whole numbers again."""
    return dedisp.fourier(fx.filterbank(spark, d), _tau(True), N_TIME, DT).select("beam", "dm_idx", "t", _r("value", 3))


@query(f"WITH {DD} SELECT beam, CAST(dm_idx AS INTEGER) AS dm_idx, t, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM (SELECT beam, dm_idx, t FROM (SELECT DISTINCT beam FROM fb), (SELECT dm_idx FROM dm), (SELECT range AS t FROM range(64))) LEFT JOIN dd USING (beam, dm_idx, t)")
def fdd_blocks(spark: SparkSession, d: str) -> DataFrame:
    """In blocks of 16 samples."""
    return dedisp.fourier(fx.filterbank(spark, d), _tau(True), N_TIME, DT, block=16).select("beam", "dm_idx", "t", _r("value", 3))


#: By the closed form of the sum of phases: what a sample at s gives to t after a turn by tau, on 128 bins.
_FRACTIONAL = f"""WITH {FB}, {DELAYS}, met AS (
  SELECT beam, dm_idx, range AS t, x, pi() * (range - fb.t + tau / 0.001::DOUBLE) / 128 AS h, cos(pi() * tau / 0.001::DOUBLE) * CASE WHEN (range - fb.t) % 2 = 0 THEN 1 ELSE -1 END AS last
  FROM fb JOIN sh USING (chan), range(64))
SELECT beam, CAST(dm_idx AS INTEGER) AS dm_idx, t, round(sum(x * (CASE WHEN abs(sin(h)) < 1e-12 THEN 127.0::DOUBLE ELSE sin(127 * h) / sin(h) END + last) / 128), 3) + 0.0 AS value FROM met GROUP BY ALL"""


@query(_FRACTIONAL)
def fdd_fractional(spark: SparkSession, d: str) -> DataFrame:
    """By phases, with the delays as they are."""
    return dedisp.fourier(fx.filterbank(spark, d), _tau(False), N_TIME, DT).select("beam", "dm_idx", "t", _r("value", 3))


@query(f"WITH {FB} SELECT beam, CAST(chan AS INTEGER) AS chan, t, CAST(x AS DOUBLE) AS x FROM (SELECT beam, t, sum(x) AS x FROM fb GROUP BY beam, t), (SELECT range AS chan FROM range(4))")
def fdd_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Without delays, what is summed over channels comes back to each of them."""
    tau = np.zeros((3, N_CHAN))
    back = dedisp.dispersed_again(dedisp.fourier(fx.filterbank(spark, d), tau, N_TIME, DT), tau[:, :4], N_TIME, DT)
    return back.select("beam", "chan", "t", _r("x", 3))


@query(f"WITH {DD}, cells AS (SELECT * FROM (SELECT DISTINCT beam FROM fb), (SELECT CAST(range AS INTEGER) AS chan FROM range(16)), (SELECT range AS t FROM range(64))) SELECT c.beam, c.chan, c.t, round(sum(coalesce(value, 0)) / 8.0::DOUBLE, 3) + 0.0 AS x FROM cells c JOIN sh USING (chan) LEFT JOIN dd ON dd.beam = c.beam AND dd.dm_idx = sh.dm_idx AND dd.t = c.t - sh.shift GROUP BY ALL")
def fdd_reverse_delayed(spark: SparkSession, d: str) -> DataFrame:
    """With each trial's own delays: every channel gets back the mean of the trials' series, turned by its delay."""
    tau = _tau(True)
    back = dedisp.dispersed_again(dedisp.fourier(fx.filterbank(spark, d), tau, N_TIME, DT), tau, N_TIME, DT)
    return back.select("beam", "chan", "t", _r("x", 3))


def _tree_sql() -> str:
    sql, state = f"WITH {FB}, s0 AS (SELECT beam, chan AS sub, 0 AS lag, t, x AS v FROM fb)", "s0"
    for k, plan in enumerate(dedisp.tree_plan(N_CHAN, N_DM, LOW, HIGH, 0.004), 1):
        rows = [f"({2 * s + 1}, {h}, {s}, {g}, {z})" for s, g, h, _, z in plan] + [f"({2 * s}, {w}, {s}, {g}, 0)" for s, g, _, w, _ in plan]
        sql += f", m{k} AS (SELECT * FROM (VALUES {', '.join(rows)}) m(sub, lag, to_sub, to_lag, shift)), s{k} AS (SELECT beam, to_sub AS sub, to_lag AS lag, t + shift AS t, sum(v) AS v FROM {state} JOIN m{k} USING (sub, lag) WHERE t + shift <= 63 GROUP BY 1, 2, 3, 4)"
        state = f"s{k}"
    return f"{sql} SELECT beam, CAST(lag AS INTEGER) AS dm_idx, t, CAST(v AS BIGINT) AS value FROM {state} WHERE sub = 0"


@query(_tree_sql())
def fdmt(spark: SparkSession, d: str) -> DataFrame:
    return dedisp.tree(fx.filterbank(spark, d), N_CHAN, N_DM, LOW, HIGH, 0.004)


_INJ = FB + "," + """ b AS (SELECT * FROM (VALUES (0, 20.0::DOUBLE, 500, 0.01::DOUBLE), (1, 30.0::DOUBLE, 700, 0.005::DOUBLE), (1, 10.0::DOUBLE, 300, 0.02::DOUBLE), (2, 0.0::DOUBLE, 900, 0.03::DOUBLE)) v(beam, dm, amplitude, t0_s)
), inj AS (
  SELECT beam, chan, t, CAST(sum(x) AS BIGINT) AS x FROM (
    SELECT beam, chan, t, x FROM fb UNION ALL
    SELECT beam, CAST(c AS INTEGER), CAST(floor((t0_s + 4.15e-3::DOUBLE * dm * (1.0::DOUBLE / ((1.2::DOUBLE + c * 0.025::DOUBLE) * (1.2::DOUBLE + c * 0.025::DOUBLE)) - 1.0::DOUBLE / (1.6::DOUBLE * 1.6::DOUBLE))) / 0.001::DOUBLE) AS BIGINT), amplitude FROM b, range(16) r(c)
  ) WHERE t BETWEEN 0 AND 63 GROUP BY beam, chan, t
)"""


def _bursts(spark):
    return spark.createDataFrame([(0, 20.0, 500, 0.01), (1, 30.0, 700, 0.005), (1, 10.0, 300, 0.02), (2, 0.0, 900, 0.03)], "beam bigint, dm double, amplitude bigint, t0_s double")


@query(f"WITH {_INJ} SELECT beam, chan, t, x FROM inj")
def inject_signal(spark: SparkSession, d: str) -> DataFrame:
    return dedisp.inject(fx.filterbank(spark, d), _bursts(spark), N_CHAN, N_TIME, LOW, HIGH, DT)


@query(f"WITH {DD} SELECT beam, dm_idx, t, value FROM (SELECT beam, dm_idx, t, CAST(sum(value) OVER w AS BIGINT) AS value, count(*) OVER w AS n FROM dd WINDOW w AS (PARTITION BY beam, dm_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4")
def boxcar(spark: SparkSession, d: str) -> DataFrame:
    return search.boxcar(_dd(spark, d), 4)


_GAUSS = np.exp(-0.5 * ((np.arange(8) - 4) / 2.0) ** 2)


@query(f"WITH {DD}, k AS (SELECT * FROM (VALUES {', '.join(f'({i - 4}, {float(w)!r}::DOUBLE)' for i, w in enumerate(_GAUSS / _GAUSS.sum()))}) v(o, w)), e AS (SELECT beam, dm_idx, min(t) AS a, max(t) AS b FROM dd GROUP BY ALL) SELECT beam, dm_idx, t - o AS t, round(sum(value * w), 5) + 0.0 AS value FROM dd JOIN e USING (beam, dm_idx), k WHERE t - o BETWEEN a AND b GROUP BY 1, 2, 3")
def gaussian_conv(spark: SparkSession, d: str) -> DataFrame:
    return search.gaussian(_dd(spark, d), 8).select("beam", "dm_idx", "t", _r("value", 5))


def _best_sql(source: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT beam, dm_idx, {w} AS width, {k} AS first, t, s, (s - {w} * {MEAN}::DOUBLE) / ({SIGMA}::DOUBLE * sqrt({w}::DOUBLE)) AS snr FROM (SELECT beam, dm_idx, t, CAST(sum(value) OVER w AS DOUBLE) AS s, count(*) OVER w AS n FROM {source} WINDOW w AS (PARTITION BY beam, dm_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) WHERE n = {w}"
        for k, w in enumerate(WIDTHS)
    )
    return f"box AS ({each}), best AS (SELECT beam, dm_idx, width, snr, s AS intensity, t AS time_idx FROM (SELECT *, row_number() OVER (PARTITION BY beam, dm_idx ORDER BY snr DESC, first, t) AS r FROM box) WHERE r = 1)"


_CAND = "SELECT beam, dm, time_idx * 0.001::DOUBLE AS time_s, round(snr, 6) AS snr, intensity, CAST(dm_idx AS INTEGER) AS dm_idx, time_idx, CAST(width AS INTEGER) AS width FROM (SELECT *, row_number() OVER (PARTITION BY beam ORDER BY snr DESC, dm_idx, time_idx) AS r FROM best) JOIN dm USING (dm_idx) WHERE r = 1 AND snr > 0"


@query(f"WITH {DD}, {_best_sql('dd')} SELECT beam, dm_idx, CAST(width AS INTEGER) AS width, round(snr, 6) + 0.0 AS snr, intensity, time_idx FROM best")
def boxcar_search(spark: SparkSession, d: str) -> DataFrame:
    return search.best_widths(_dd(spark, d), WIDTHS, MEAN, SIGMA).select("beam", "dm_idx", "width", _r("snr"), "intensity", "time_idx")


@query(f"WITH {DD}, {_best_sql('dd')} SELECT beam, dm_idx, CAST(width AS INTEGER) AS width, round(snr, 6) + 0.0 AS snr, intensity, time_idx FROM best")
def boxcar_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    best = search.best_widths(_dd(spark, d), WIDTHS, MEAN, SIGMA, block=16)
    return best.select("beam", "dm_idx", "width", _r("snr"), "intensity", "time_idx")


@query(f"WITH {DD}, {_best_sql('dd')} {_CAND}")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return search.candidates(search.best_widths(_dd(spark, d), WIDTHS, MEAN, SIGMA), _dms(spark), DT).withColumn("snr", F.round("snr", 6))


_SEARCH = f"{_INJ}, {DELAYS}, dd AS (SELECT beam, dm_idx, t - shift AS t, CAST(sum(x) AS BIGINT) AS value FROM inj JOIN sh USING (chan) WHERE t - shift BETWEEN 0 AND 63 GROUP BY 1, 2, 3), {_best_sql('dd')}"


def _searched(spark, d, most=None):
    fb = dedisp.inject(fx.filterbank(spark, d), _bursts(spark), N_CHAN, N_TIME, LOW, HIGH, DT)
    return pipelines.searched(fb, _dms(spark), _shifts(spark), WIDTHS, MEAN, SIGMA, DT, N_TIME, most)


@query(f"WITH {_SEARCH} {_CAND} ORDER BY beam LIMIT 10")
def dedisp_search(spark: SparkSession, d: str) -> DataFrame:
    """The first ten beams' candidates, in order of beam."""
    return _searched(spark, d, 10).withColumn("snr", F.round("snr", 6))


@query(f"WITH {_SEARCH}, cand AS ({_CAND}) SELECT CAST(b.beam AS BIGINT) AS beam, bool_or(coalesce(abs(c.dm - b.dm) < 5 AND abs(c.time_s - b.t0_s) < 0.05 AND c.snr > 0.1, false)) AS matched FROM b LEFT JOIN cand c USING (beam) GROUP BY b.beam")
def verify_matches(spark: SparkSession, d: str) -> DataFrame:
    return search.verified(_searched(spark, d), _bursts(spark), snr=0.1)


@query()
def multi_candidate(spark: SparkSession, d: str) -> DataFrame:
    fb = dedisp.inject(fx.filterbank(spark, d), _bursts(spark), N_CHAN, N_TIME, LOW, HIGH, DT)
    return search.many_candidates(dedisp.shifted_sum(fb, _shifts(spark), N_TIME), WIDTHS, [i / 7 * MOST_DM for i in range(8)], DT, 3)


@query(f"WITH {FB} SELECT beam, chan, t, CAST(greatest(least(sign(x / 4.0::DOUBLE + 127.5::DOUBLE) * floor(abs(x / 4.0::DOUBLE + 127.5::DOUBLE) + 0.5), 255), 0) AS INTEGER) AS q FROM fb")
def filterbank_u8(spark: SparkSession, d: str) -> DataFrame:
    return fx.filterbank(spark, d).select("beam", "chan", "t", bits.quantise_zero_mean(F.col("x") / 4.0).alias("q"))


@query(f"WITH {_INJ} SELECT beam, chan, t, CAST(greatest(least(sign(x / 4.0::DOUBLE + 127.5::DOUBLE) * floor(abs(x / 4.0::DOUBLE + 127.5::DOUBLE) + 0.5), 255), 0) AS INTEGER) AS q FROM inj")
def simulated_u8(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain of a simulation: noise, bursts, quantised."""
    fb = dedisp.inject(fx.filterbank(spark, d), _bursts(spark), N_CHAN, N_TIME, LOW, HIGH, DT)
    return fb.select("beam", "chan", "t", bits.quantise_zero_mean(F.col("x") / 4.0).alias("q"))


def _float_sql(x: str, fraction: int, least: int, most: float, beyond: str) -> str:
    """A narrow float by powers of two, for DuckDB."""
    step = f"pow(2.0::DOUBLE, greatest(CASE WHEN pow(2.0::DOUBLE, e) > abs({x}) THEN e - 1 WHEN pow(2.0::DOUBLE, e + 1) <= abs({x}) THEN e + 1 ELSE e END, {least}) - {fraction})"
    r = f"round_even(abs({x}) / {step}, 0) * {step}"
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE sign({x}) * CASE WHEN {r} > {most}::DOUBLE THEN {beyond} ELSE {r} END END"


_SPREAD = "(value - 200) * value * value * 0.01::DOUBLE"


@query(f"WITH s AS (SELECT event_id, {_SPREAD} AS x FROM events), y AS (SELECT *, floor(log2(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE abs(x) END)) AS e FROM s) SELECT event_id, {_float_sql('x', 10, -14, 65504.0, chr(39) + 'infinity' + chr(39) + '::DOUBLE')} AS half, {_float_sql('x', 7, -126, 3.3895313892515355e38, chr(39) + 'infinity' + chr(39) + '::DOUBLE')} AS bfloat16, {_float_sql('x', 3, -6, 448.0, '448.0::DOUBLE')} AS e4m3, {_float_sql('x', 2, -14, 57344.0, '57344.0::DOUBLE')} AS e5m2 FROM y")
def narrow_floats(spark: SparkSession, d: str) -> DataFrame:
    """Rounding to 16 and 8 bits; the 8-bit formats saturate. An input of minus zero (what a value of 0 gives) is zero."""
    v = F.col("value")
    x = fx.table(spark, d, "events").select("event_id", ((v - 200) * v * v * F.lit(0.01) + 0.0).alias("x"))
    return x.select("event_id", *[bits.as_float(F.col("x"), f, f[0] == "e").alias(f) for f in bits.FORMATS])


@query(f"WITH {TRI}, y AS (SELECT *, floor(log2(CASE WHEN re = 0 THEN 1.0::DOUBLE ELSE abs(re) END)) AS e FROM tri) SELECT chan, pol, t_inner, ant_i, ant_j, {_float_sql('re', 10, -14, 65504.0, chr(39) + 'infinity' + chr(39) + '::DOUBLE')} AS re FROM y")
def xengine_half(spark: SparkSession, d: str) -> DataFrame:
    """The correlation's real part in half precision."""
    return _tri(spark, d).select("chan", "pol", "t_inner", "ant_i", "ant_j", bits.as_float(F.col("re")).alias("re"))


@query("SELECT n_ant, n_time, 8 * n_time * n_ant * (n_ant + 1) // 2 AS herk_flops, 8 * n_time * n_ant * 64 AS beam_flops, 2 * n_time * n_ant AS bytes_in FROM (SELECT 8 * (1 + id) AS n_ant, 1000 * (1 + id % 3) AS n_time FROM range(16) r(id))")
def cost_model(spark: SparkSession, d: str) -> DataFrame:
    s = spark.range(16).select((8 * (1 + F.col("id"))).alias("n_ant"), (1000 * (1 + F.col("id") % 3)).alias("n_time"))
    return s.select("n_ant", "n_time", F.expr("8 * n_time * n_ant * (n_ant + 1) div 2").alias("herk_flops"), (8 * F.col("n_time") * F.col("n_ant") * 64).alias("beam_flops"), (2 * F.col("n_time") * F.col("n_ant")).alias("bytes_in"))


# ---- streams, run over what is there


_BLOCKS = "WITH x AS (SELECT event_id // 64 AS block, CAST(event_id % 8 AS INTEGER) AS beam, CAST(floor(value) AS BIGINT) % 256 AS value FROM events)"


def _power_blocks(e):
    return e.select(F.expr("event_id div 64").alias("block"), (F.col("event_id") % 8).cast("int").alias("beam"), (F.floor("value").cast("bigint") % 256).alias("value"))


@query(f"{_BLOCKS} SELECT beam, block // 8 AS cycle, round(avg(value), 6) AS mean, round(avg((value - 70) * (value - 70)), 4) AS mean_square FROM x GROUP BY beam, block // 8 HAVING count(DISTINCT block) = 8")
def stream_power_cycle(spark: SparkSession, d: str) -> DataFrame:
    folder = sources.work_folder(spark)
    s = blocks.power_cycle(_power_blocks(sources.of_table(spark, d, "events")))
    return sources.finished(spark, blocks.to_folder(s, f"{folder}/out", f"{folder}/state"), f"{folder}/out", s.schema).select("beam", "cycle", _r("mean"), _r("mean_square", 4))


@query(f"WITH {TRI} SELECT chan, pol, t_inner, ant_i, ant_j, re, im FROM tri")
def stream_xengine(spark: SparkSession, d: str) -> DataFrame:
    """Each micro-batch's correlations are written; their sum is the whole."""
    folder = sources.work_folder(spark)
    e = sources.of_table(spark, d, "events")
    v = fx.packed(e)
    part = blocks.to_folder(v, f"{folder}/out", f"{folder}/state", blocks.correlated)
    got = sources.finished(spark, part, f"{folder}/out", _tri(spark, d).schema)
    return got.groupBy("chan", "pol", "t_inner", "ant_i", "ant_j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


@query(f"WITH {BEAMS} SELECT chan, pol, t, beam, re, im FROM z")
def stream_beams(spark: SparkSession, d: str) -> DataFrame:
    """Beams of each micro-batch, whose weights are read when it begins; samples of one time may come in two batches."""
    folder = sources.work_folder(spark)
    v = fx.packed(sources.of_table(spark, d, "events"))
    made = blocks.to_folder(v, f"{folder}/out", f"{folder}/state", lambda b: blocks.beams_with(b, lambda: fx.weights(spark)))
    got = sources.finished(spark, made, f"{folder}/out", _beams(spark, d).schema)
    return got.groupBy("chan", "pol", "t", "beam").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


@query(f"WITH {DD} SELECT beam, CAST(dm_idx AS INTEGER) AS dm_idx, t, value FROM dd WHERE t < 64 - (SELECT max(shift) FROM sh)")
def stream_dedisp(spark: SparkSession, d: str) -> DataFrame:
    """A filterbank's stream with the overlap kept as state; a beam's channels may come in several batches, whose shares add up."""
    folder = sources.work_folder(spark)
    shifts = np.rint(_tau(True) / DT).astype(int)
    s = blocks.dedispersed_stream(fx.channels(sources.of_table(spark, d, "embeddings")), shifts)
    got = sources.finished(spark, blocks.to_folder(s, f"{folder}/out", f"{folder}/state"), f"{folder}/out", s.schema)
    return got.groupBy("beam", "dm_idx", "t").agg(F.sum("value").cast("bigint").alias("value"))
