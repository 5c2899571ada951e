"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The inputs that the Spark side derives in sources.fixtures, for DuckDB.
VOLT = """
volt AS (
  SELECT event_id // 64 AS t, CAST((event_id // 16) % 4 AS INTEGER) AS chan, CAST(event_id % 8 AS INTEGER) AS ant,
    CAST((event_id // 8) % 2 AS INTEGER) AS pol, CAST(floor(value * 100) AS BIGINT) % 256 AS byte FROM events
), sm AS (
  SELECT t, chan, ant, pol, byte,
    CAST(CASE WHEN (byte >> 4) >= 8 THEN 8 - (byte >> 4) ELSE byte >> 4 END AS BIGINT) AS re,
    CAST(CASE WHEN (byte & 15) >= 8 THEN 8 - (byte & 15) ELSE byte & 15 END AS BIGINT) AS im FROM volt
)"""
TRI = VOLT + """, tri AS (
  SELECT i.chan, i.pol, CAST(i.t % 2 AS INTEGER) AS t_inner, i.ant AS ant_i, j.ant AS ant_j,
    CAST(sum(i.re * j.re + i.im * j.im) AS BIGINT) AS re, CAST(sum(i.im * j.re - i.re * j.im) AS BIGINT) AS im
  FROM sm i JOIN sm j ON i.chan = j.chan AND i.pol = j.pol AND i.t = j.t AND j.ant <= i.ant GROUP BY ALL
)"""
FB = """
fb AS (
  SELECT vec_id // 16 AS beam, CAST(vec_id % 16 AS INTEGER) AS chan, CAST(p - 1 AS BIGINT) AS t,
    CAST(round_even(CAST(embedding[p] AS DOUBLE) * 1000, 0) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS p FROM embeddings)
)"""
MAT = """
mat AS (
  SELECT vec_id AS b, CAST((p - 1) // 8 AS INTEGER) AS i, CAST((p - 1) % 8 AS INTEGER) AS k,
    CAST(round_even(CAST(embedding[p] AS DOUBLE) * 100, 0) AS BIGINT) AS re, CAST(((p - 1) * 5 + vec_id) % 11 - 5 AS BIGINT) AS im
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS p FROM embeddings)
)"""
WEIGHTS = """
w AS (
  SELECT CAST(id // 64 AS INTEGER) AS chan, CAST((id // 8) % 8 AS INTEGER) AS beam, CAST(id % 8 AS INTEGER) AS ant,
    ((id // 8) % 8 * 7 + id % 8 * 3 + id // 64) % 15 - 7 AS wre, ((id // 8) % 8 * 5 + id % 8 * 11 + id // 64 * 2) % 15 - 7 AS wim FROM range(256) r(id)
)"""
BEAMS = VOLT + "," + WEIGHTS + """, z AS (
  SELECT chan, pol, t, beam, CAST(sum(wre * re - wim * im) AS BIGINT) AS re, CAST(sum(wre * im + wim * re) AS BIGINT) AS im FROM sm JOIN w USING (chan, ant) GROUP BY ALL
), ib AS (
  SELECT chan, t, CAST(sum(re * re + im * im) AS BIGINT) AS ib FROM sm WHERE ant % 5 <> 3 GROUP BY ALL
), ps AS (
  SELECT chan, beam, t // 4 AS t, CAST(sum(p - ib) AS BIGINT) AS value
  FROM (SELECT chan, beam, t, sum(re * re + im * im) AS p FROM z GROUP BY ALL) JOIN ib USING (chan, t) GROUP BY 1, 2, 3
)"""
GEO = """
g AS (SELECT CAST(id AS INTEGER) AS ant, id * 13.5::DOUBLE - (id % 3) * 4.25::DOUBLE AS e, id * 7.75::DOUBLE + (id % 4) * 2.5::DOUBLE AS n FROM range(8) r(id)
), cal AS (
  SELECT CAST(id // 8 AS INTEGER) AS ant, CAST((id // 2) % 4 AS INTEGER) AS fq, CAST(id % 2 AS INTEGER) AS pol, CAST((id * 7) % 9 - 4 AS DOUBLE) AS re, CAST((id * 5) % 7 - 3 AS DOUBLE) AS im FROM range(64) r(id)
), fr AS (SELECT CAST(id AS INTEGER) AS fq, 1e6::DOUBLE * (1498.75::DOUBLE - id * 0.244140625::DOUBLE) AS hz FROM range(4) r(id))"""
CELLS = GEO + """, bl AS (
  SELECT i.ant AS ant_i, j.ant AS ant_j, i.e - j.e AS u_m, i.n - j.n AS v_m FROM g i JOIN g j ON j.ant <= i.ant
), cell AS (
  SELECT fq AS chan, ant_i, ant_j, CAST(round(u_m / (299792458.0::DOUBLE / hz) / 20.0::DOUBLE + 32) AS BIGINT) AS iu, CAST(round(v_m / (299792458.0::DOUBLE / hz) / 20.0::DOUBLE + 32) AS BIGINT) AS iv,
    CAST(round(-u_m / (299792458.0::DOUBLE / hz) / 20.0::DOUBLE + 32) AS BIGINT) AS ju, CAST(round(-v_m / (299792458.0::DOUBLE / hz) / 20.0::DOUBLE + 32) AS BIGINT) AS jv FROM bl, fr
)"""
GRID = TRI + "," + CELLS + """, vis AS (SELECT chan, ant_i, ant_j, sum(re) AS re, sum(im) AS im FROM tri GROUP BY ALL
), put AS (
  SELECT chan, iv, iu, re, im FROM vis JOIN cell USING (chan, ant_i, ant_j) UNION ALL SELECT chan, jv, ju, re, -im FROM vis JOIN cell USING (chan, ant_i, ant_j) WHERE ant_i <> ant_j
), grid AS (
  SELECT chan, iv, iu, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM put WHERE iv BETWEEN 0 AND 63 AND iu BETWEEN 0 AND 63 GROUP BY ALL
), px AS (SELECT CAST(id AS INTEGER) AS beam, CAST(CASE WHEN id = 7 THEN 64 ELSE id * 9 % 64 END AS INTEGER) AS row, CAST((id * id * 5 + 3) % 64 AS INTEGER) AS col FROM range(8) r(id)
), dft AS (
  SELECT chan, beam, CASE WHEN row > 63 THEN 0.0 ELSE (zr * zr + zi * zi) / 4096 END AS value FROM (
    SELECT chan, beam, row, col, sum(re * cos(a) - im * sin(a)) AS zr, sum(re * sin(a) + im * cos(a)) AS zi
    FROM (SELECT chan, beam, row, col, re, im, 2 * pi() / 64 * ((row * iv + col * iu) % 64) AS a FROM grid, px) GROUP BY ALL)
)"""
#: 16 channels over 1.2-1.6 GHz, 8 trials up to 40, 1 ms samples.
DELAYS = """
dm AS (SELECT CAST(id AS INTEGER) AS dm_idx, id / 7.0::DOUBLE * 40.0::DOUBLE AS dm FROM range(8) r(id)
), sh AS (
  SELECT dm_idx, dm, chan, tau, CAST(sign(tau) * floor(abs(tau / 0.001::DOUBLE) + 0.5) AS BIGINT) AS shift
  FROM (SELECT dm_idx, dm, CAST(c AS INTEGER) AS chan, 4.15e-3::DOUBLE * dm * (1.0::DOUBLE / ((1.2::DOUBLE + c * 0.025::DOUBLE) * (1.2::DOUBLE + c * 0.025::DOUBLE)) - 1.0::DOUBLE / (1.6::DOUBLE * 1.6::DOUBLE)) AS tau FROM dm, range(16) r(c))
)"""
DD = FB + "," + DELAYS + """, dd AS (
  SELECT beam, dm_idx, t - shift AS t, CAST(sum(x) AS BIGINT) AS value FROM fb JOIN sh USING (chan) WHERE t - shift BETWEEN 0 AND 63 GROUP BY 1, 2, 3
)"""
