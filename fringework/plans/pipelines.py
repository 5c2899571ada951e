"""The three pipelines as compositions of operators; Catalyst plans each as one query."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fringework.functions import bits
from fringework.operators import contract, decode, dedisp, imaging, layout, reduce, search
from pyspark.sql import functions as F


@dataclass
class Catalog:
    """The arrays of an observation by name, as views of the session."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def put(self, name: str, table: DataFrame, columns: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
        """Names a table. A ValueError says which of ``columns`` (name: type) is missing or of another type, or that it doesn't have ``rows`` rows."""
        kinds = dict(table.dtypes)
        wrong = [f"{c} {t}" for c, t in (columns or {}).items() if kinds.get(c) != t]
        if wrong:
            raise ValueError(f"{name} has to have {', '.join(wrong)}; it has {', '.join(f'{c} {t}' for c, t in table.dtypes)}")
        if rows is not None and (there := table.count()) != rows:
            raise ValueError(f"{name} has to have {rows} rows; it has {there}")
        table.createOrReplaceTempView(name)
        self.tables[name] = table
        return table

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def visibilities(voltage: DataFrame, inner: int = 1, form: str | None = None, n_ant: int | None = None) -> DataFrame:
    """Packed voltages to a lower triangle with its index, summed over polarisations."""
    v = decode.split_time(decode.decode(voltage), inner)
    tri = contract.correlate(v, form=form, n_ant=n_ant)
    return layout.with_lower_index(reduce.pol_reduce(tri))


def imaged(voltage: DataFrame, baselines: DataFrame, freqs: DataFrame, pixels: DataFrame, n: int, size: float, taper: DataFrame | None = None, scale: float = 1.0, dense: bool | None = None) -> DataFrame:
    """(chan, beam, value 0..255): correlate, grid, taper, image at the beams' pixels, quantise."""
    vis = visibilities(voltage).select("chan", "ant_i", "ant_j", "re", "im")
    g = imaging.tapered(imaging.grid(vis, imaging.cells(baselines, freqs, size, n), n), taper)
    z = imaging.intensity(g, pixels, n, None if dense is None else "dense" if dense else "sparse")
    return imaging.quantised(z, scale)


def beam_powers(voltage: DataFrame, weights: DataFrame, factor: int, scale: float | None = None, conjugate: bool = False) -> DataFrame:
    """(chan, beam, t, value): beams, power of both polarisations over ``factor`` times, as bytes if scaled."""
    p = reduce.stokes_i(contract.beamform(decode.decode(voltage), weights, conjugate), factor)
    return p if scale is None else p.withColumn("value", bits.quantise_even(F.col("value").cast("double"), scale))


def searched(fb: DataFrame, dms: DataFrame, shifts: DataFrame, widths: Sequence[int], mean: float, sigma: float, dt: float, n_time: int, most: int | None = None) -> DataFrame:
    """Dedisperse, search all widths, and the best candidate of each beam."""
    return search.candidates(search.best_widths(dedisp.shifted_sum(fb, shifts, n_time), widths, mean, sigma), dms, dt, most)
