"""Contractions: products over shared axes, summed.

A contraction is an equi-join on the shared axes and a grouped sum, or, where every row meets many
others of its batch, a ``block`` form that gathers a bounded piece of the batch and multiplies it as
a matrix. Whole-number inputs give exact results in either form and any order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fringework.operators import tiles

#: Antennas, columns or beams above which the block form is taken, and bytes of the samples of one block.
MANY, BLOCK_BYTES = 48, 8 << 20


def _counted(d: DataFrame, *names: str) -> int:
    """How many different values the columns have together, about; one small aggregation. Streams aren't counted."""
    return 0 if d.isStreaming else d.agg(F.approx_count_distinct(F.struct(*names))).first()[0]


def _form(form: str | None, n: int) -> str:
    if form not in (None, "relational", "block"):
        raise ValueError("form must be relational or block")
    return form or ("block" if n > MANY else "relational")


def correlate(v: DataFrame, batch: Sequence[str] = ("chan", "pol", "t_inner"), time: str = "k", form: str | None = None, n_ant: int | None = None) -> DataFrame:
    """(batch, ant_i, ant_j, re, im), ant_j <= ant_i: the sum over time of A_i times the conjugate of A_j.

    v has batch, time, ant, re, im, one row for each. Missing samples count as zero. The relational form
    brings the rows of one (batch, time) together, no more of them than antennas, and makes a row for each
    pair; the block form, taken by itself above MANY antennas (counted where n_ant is not given), multiplies
    blocks of times of BLOCK_BYTES as matrices.
    """
    n = (n_ant or _counted(v, "ant")) if form is None or form == "block" else 0
    if _form(form, n) == "block":
        return _correlate_blocks(v, list(batch), time, ["ant"], n)
    at = v.groupBy(*batch, time).agg(F.array_sort(F.collect_list(F.struct("ant", "re", "im"))).alias("a"))
    rows = at.select(*batch, "a", F.posexplode("a").alias("p", "i"))
    rows = rows.select(*batch, "i", F.explode(F.slice("a", 1, F.col("p") + 1)).alias("j"))
    ir, ii, jr, ji = (F.col(x) for x in ("i.re", "i.im", "j.re", "j.im"))
    rows = rows.select(*batch, F.col("i.ant").alias("ant_i"), F.col("j.ant").alias("ant_j"), (ir * jr + ii * ji).alias("re"), (ii * jr - ir * ji).alias("im"))
    return rows.groupBy(*batch, "ant_i", "ant_j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _correlate_blocks(v: DataFrame, batch: list[str], time: str, inputs: list[str], n: int) -> DataFrame:
    """A matrix product for each batch and block of times, then a sum of the few results. inputs: ant, or ant and pol."""
    kinds = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    whole = all(kinds[c] in tiles.WHOLE for c in ("re", "im"))
    number = "bigint" if whole else "double"
    pair = [f"{c}_{side}" for c in inputs for side in "ij"]
    out = ", ".join([f"`{c}` {kinds[c]}" for c in batch] + [f"{c} {kinds[c[:-2]]}" for c in pair]) + f", re {number}, im {number}"
    block = max(1, BLOCK_BYTES // (16 * max(1, n)))

    def product(key, table: pa.Table) -> pa.Table:
        times, ti = np.unique(table[time].to_numpy(), return_inverse=True)
        at, values = tiles.places(table, inputs)
        x = tiles.dense(table, ti, at, (len(times), len(values[0])), "re", "im")
        c = x.T @ x.conj()
        i, j = (a.ravel() for a in np.indices(c.shape))
        ant = values[0].to_numpy()
        ok = ant[j] <= ant[i]
        if len(inputs) > 1:
            pol = values[1].to_numpy()
            ok &= pol[i] != pol[j]
        i, j = i[ok], j[ok]
        re, im = tiles.parted(c[i, j], whole)
        cols = {name: pa.array([k.as_py()] * len(i), table[name].type) for name, k in zip(batch, key)}
        cols |= {f"{name}_{side}": v.take(pa.array(at)) for name, v in zip(inputs, values) for side, at in (("i", i), ("j", j))}
        return pa.table(cols | {"re": re, "im": im})

    part = v.select(*batch, time, *inputs, "re", "im", F.floor(F.col(time) / block).alias("_block")).groupBy(*batch, "_block")
    done = part.applyInArrow(lambda key, table: product(key[:-1], table), out)
    return done.groupBy(*batch, *pair).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def cross_polar(v: DataFrame, batch: Sequence[str] = ("chan",), time: str = "t", form: str | None = None, n_ant: int | None = None) -> DataFrame:
    """(batch, ant_i, ant_j, pol_i, pol_j, re, im) for different polarisations, ant_j <= ant_i; forms as in correlate()."""
    n = (n_ant or _counted(v, "ant")) if form is None or form == "block" else 0
    if _form(form, n) == "block":
        return _correlate_blocks(v, list(batch), time, ["ant", "pol"], 2 * n).select(*batch, "ant_i", "ant_j", "pol_i", "pol_j", "re", "im")
    at = v.groupBy(*batch, time).agg(F.collect_list(F.struct("ant", "pol", "re", "im")).alias("a"))
    rows = at.select(*batch, "a", F.explode("a").alias("i")).select(*batch, "i", F.explode("a").alias("j")).where("j.ant <= i.ant and j.pol <> i.pol")
    ir, ii, jr, ji = (F.col(x) for x in ("i.re", "i.im", "j.re", "j.im"))
    rows = rows.select(*batch, F.col("i.ant").alias("ant_i"), F.col("j.ant").alias("ant_j"), F.col("i.pol").alias("pol_i"), F.col("j.pol").alias("pol_j"), (ir * jr + ii * ji).alias("re"), (ii * jr - ir * ji).alias("im"))
    return rows.groupBy(*batch, "ant_i", "ant_j", "pol_i", "pol_j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def accumulate(new: DataFrame, old: DataFrame, keys: Sequence[str], alpha: float = 1, beta: float = 1) -> DataFrame:
    """alpha * new + beta * old, where what is missing on a side counts as zero. No join: one grouped sum."""
    part = lambda d, x: d.select(*keys, (F.col("re") * x).alias("re"), (F.col("im") * x).alias("im"))
    return part(new, alpha).unionByName(part(old, beta)).groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _operand(m: DataFrame, op: str, row: str, col: str, names: tuple[str, str]) -> DataFrame:
    """m as op asks for: N as it is, T with row and column exchanged, C conjugate and exchanged."""
    if op not in "NTC":
        raise ValueError("op must be N, T or C")
    a, b = (row, col) if op == "N" else (col, row)
    rest = [c for c in m.columns if c not in (row, col, "re", "im")]
    return m.select(*rest, F.col(a).alias(names[0]), F.col(b).alias(names[1]), "re", (-F.col("im") if op == "C" else F.col("im")).alias("im"))


def gemm(a: DataFrame, b: DataFrame, op_a: str = "N", op_b: str = "N", alpha: complex = 1, beta: complex = 0, c: DataFrame | None = None, batch: str | None = "b", form: str | None = None, most_rows_sent: int = 0) -> DataFrame:
    """(batch, i, j, re, im) = alpha op(A) op(B) + beta C for a(b, i, k), b(b, k, j), c(b, i, j).

    op is about the stored axes: with T or C a is stored as (k, i). If b has no batch column the same
    matrix serves every batch. The relational form joins on k; the block form, taken by itself for more
    than MANY columns, multiplies tiles. b is sent whole only if it has at most ``most_rows_sent`` rows.
    """
    x = _operand(a, op_a, "i", "k", ("i", "k")).select("b", "i", "k", F.col("re").alias("ar"), F.col("im").alias("ai"))
    own = [batch] if batch and batch in b.columns else []
    y = _operand(b, op_b, "k", "j", ("k", "j")).select(*own, "k", "j", F.col("re").alias("br"), F.col("im").alias("bi"))
    if _form(form, _counted(y, "j") if form is None else 0) == "block":
        out = tiles.product(x, y, own, [n for n in ("b", "i") if n not in own], "k", ["j"]).select("b", "i", "j", "re", "im")
    else:
        sent = most_rows_sent and y.limit(most_rows_sent + 1).count() <= most_rows_sent
        rows = x.join(F.broadcast(y) if sent else y, [*own, "k"])
        re, im = F.sum(F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")), F.sum(F.col("ar") * F.col("bi") + F.col("ai") * F.col("br"))
        out = rows.groupBy("b", "i", "j").agg(re.alias("re"), im.alias("im"))
    out = _times(out, alpha)
    if c is not None and beta:
        return accumulate(out, _times(c.select("b", "i", "j", "re", "im"), beta), ("b", "i", "j"))
    return out


def _whole(x: float):
    return int(x) if float(x).is_integer() else float(x)


def _times(m: DataFrame, z: complex) -> DataFrame:
    if z == 1:
        return m
    r, i = _whole(complex(z).real), _whole(complex(z).imag)
    return m.select("b", "i", "j", (F.col("re") * r - F.col("im") * i).alias("re"), (F.col("re") * i + F.col("im") * r).alias("im"))


def power_gemm(a: DataFrame, b: DataFrame, alpha: float = 1, beta: float = 0, p: DataFrame | None = None, **how) -> DataFrame:
    """(b, i, j, value) = alpha |A op(B)|^2 + beta P."""
    z = gemm(a, b, **how)
    out = z.select("b", "i", "j", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * _whole(alpha)).alias("value"))
    if p is None or not beta:
        return out
    both = out.unionByName(p.select("b", "i", "j", (F.col("value") * _whole(beta)).alias("value")))
    return both.groupBy("b", "i", "j").agg(F.sum("value").alias("value"))


def beamform(v: DataFrame, weights: DataFrame, conjugate: bool = False, keys: Sequence[str] = ("chan", "pol", "t"), most_weight_rows: int = 2_000_000, form: str | None = None) -> DataFrame:
    """(chan, pol, t, beam, re, im): the sum over antennas of weight times voltage (or its conjugate).

    weights has chan, beam, ant, wre, wim, and pol if they differ by polarisation. In the relational form they
    are sent whole to every executor if they have at most ``most_weight_rows`` rows, else joined by shuffle,
    and every sample meets every beam; the block form, taken by itself above MANY beams, multiplies tiles.
    """
    on = ["chan", "ant"] + (["pol"] if "pol" in weights.columns else [])
    w = weights.select(*on, "beam", "wre", "wim")
    s = -1 if conjugate else 1
    if _form(form, _counted(w, "beam") if form is None else 0) == "block":
        x = v.select(*keys, "ant", F.col("re").alias("ar"), (s * F.col("im")).alias("ai"))
        y = w.withColumnsRenamed({"wre": "br", "wim": "bi"})
        own = [c for c in on if c != "ant"]
        return tiles.product(x, y, own, [k for k in keys if k not in own], "ant", ["beam"]).select(*keys, "beam", "re", "im")
    if weights.limit(most_weight_rows + 1).count() <= most_weight_rows:
        w = F.broadcast(w)
    re = F.sum(F.col("wre") * F.col("re") - s * F.col("wim") * F.col("im"))
    im = F.sum(s * F.col("wre") * F.col("im") + F.col("wim") * F.col("re"))
    return v.join(w, on).groupBy(*keys, "beam").agg(re.alias("re"), im.alias("im"))


def beamform_by_arm(v: DataFrame, weights: DataFrame, n_ant: int, conjugate: bool = False) -> DataFrame:
    """(chan, pol, t, arm, beam, re, im): each half of the antennas makes its own beams."""
    arm = F.floor(F.col("ant") / (n_ant // 2)).cast("int")
    return beamform(v.withColumn("arm", arm), weights, conjugate, ("chan", "pol", "t", "arm"))


def power(z: DataFrame) -> Column:
    return F.col("re") * F.col("re") + F.col("im") * F.col("im")
