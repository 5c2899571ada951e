"""Block by block: power cycles, correlation and dedispersion of a stream.

A stream is any streaming DataFrame whose rows carry their block; a ring buffer's reader or a folder of
Parquet files will do. Sinks get whole micro-batches, and a batch that is run again overwrites what it
wrote, since its path is its number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fringework.operators import contract, decode, dedisp


def cycle_sums(blocks: DataFrame, cycle: int = 8, about: float = 70.0) -> DataFrame:
    """(beam, cycle, mean, mean_square): over ``cycle`` blocks each; a batch or an update-mode stream.

    blocks has (block, beam, value). As a grouped aggregate its state is one row for each beam and cycle.
    """
    d = F.col("value") - about
    return blocks.groupBy("beam", F.floor(F.col("block") / cycle).cast("bigint").alias("cycle")).agg(F.avg("value").alias("mean"), F.avg(d * d).alias("mean_square"))


def power_cycle(blocks: DataFrame, cycle: int = 8, about: float = 70.0) -> DataFrame:
    """As cycle_sums(), but a cycle comes out once, when all of its blocks are there, and is then forgotten.

    blocks is a stream of (block, beam, value). State for a beam: sums for each cycle that isn't full.
    """

    def step(key, frames, state: GroupState):
        open_: dict[int, list] = {int(c): [int(n), float(s), float(q), set(b)] for c, n, s, q, b in (state.get[0] if state.exists else [])}
        for f in frames:
            for c, part in f.groupby(f["block"] // cycle):
                x = open_.setdefault(int(c), [0, 0.0, 0.0, set()])
                v = part["value"].astype(float)
                x[0] += len(part)
                x[1] += float(v.sum())
                x[2] += float(((v - about) ** 2).sum())
                x[3] |= {int(b) for b in part["block"]}
        done = sorted(c for c, x in open_.items() if len(x[3]) == cycle)
        out = [(key[0], c, open_[c][1] / open_[c][0], open_[c][2] / open_[c][0]) for c in done]
        for c in done:
            del open_[c]
        state.update(([(c, n, s, q, sorted(b)) for c, (n, s, q, b) in open_.items()],))
        yield pd.DataFrame(out, columns=["beam", "cycle", "mean", "mean_square"])

    return blocks.groupBy("beam").applyInPandasWithState(
        step, "beam int, cycle bigint, mean double, mean_square double",
        "open array<struct<c: bigint, n: bigint, s: double, q: double, b: array<bigint>>>", "append", GroupStateTimeout.NoTimeout,
    )


def to_folder(stream: DataFrame, path: str, checkpoint: str, transform=None, mode: str = "append"):
    """Runs a stream over what is there now; each micro-batch, transformed, is written below path by its number."""

    def put(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correlated(voltage: DataFrame, inner: int = 2) -> DataFrame:
    """Partial correlations of a batch of voltages, by the blocks in it; their sum over blocks is the whole."""
    v = decode.split_time(decode.decode(voltage), inner)
    return contract.correlate(v)


def beams_with(stream: DataFrame, weights) -> DataFrame:
    """A stream of voltages joined with weights as they are when each batch begins: ``weights()`` is read again."""
    return contract.beamform(decode.decode(stream), weights())


def dedispersed_stream(fb: DataFrame, shifts: np.ndarray) -> DataFrame:
    """(beam, dm_idx, t, value): a stream of (beam, chan, t, x) dedispersed as it comes, with the overlap kept as state.

    shifts[dm, chan] in samples. A time comes out in the micro-batch that brings the last channel's sample that its
    largest shift needs, of the channels that have come by then; what a stream's end leaves incomplete doesn't come
    out. What comes later for a time that is out (a beam's other channels, say, which lie in another file) comes out
    as one more row with its share, so rows of one (beam, dm_idx, t) add up; where each block brings every channel of
    its beam, there is one row. The state of a beam is its samples from the first time that isn't out on: as many as
    the largest shift, and what came ahead of other channels.
    """
    most, n_chan = int(shifts.max(initial=0)), shifts.shape[1]

    def step(key, frames, state: GroupState):
        first, *kept = state.get if state.exists else (0, [], [], [])
        rows = pd.concat([*frames, pd.DataFrame({"chan": [], "t": [], "x": []})])
        rows = rows[(rows["t"] >= 0) & (rows["chan"] >= 0) & (rows["chan"] < n_chan)]
        new = [rows[c].to_numpy().astype(kind) for c, kind in (("chan", np.int64), ("t", np.int64), ("x", float))]
        for d, row in enumerate(shifts if first else ()):  # shares of times that are out
            at = new[1] - row[new[0]]
            late = (at >= 0) & (at < first)
            if late.any():
                times, place = np.unique(at[late], return_inverse=True)
                yield pd.DataFrame({"beam": [key[0]] * len(times), "dm_idx": d, "t": times, "value": np.bincount(place, new[2][late])})
        chan, t, x = (np.concatenate((np.asarray(a, b.dtype), b)) for a, b in zip(kept, new))
        ok = t >= first
        chan, t, x = chan[ok], t[ok], x[ok]
        high = min((int(t[chan == c].max()) for c in np.unique(chan)), default=-1)
        end = max(first, high - most + 1)
        if end > first:
            dense = np.zeros((n_chan, high - first + 1))
            use = t <= high
            np.add.at(dense, (chan[use], t[use] - first), x[use])
            n = end - first
            for d, row in enumerate(shifts):
                value = sum(dense[c, s : s + n] for c, s in enumerate(row.tolist()))
                yield pd.DataFrame({"beam": [key[0]] * n, "dm_idx": d, "t": np.arange(first, end), "value": value})
        left = t >= end
        state.update((end, chan[left].tolist(), t[left].tolist(), x[left].tolist()))

    rows = fb.select(F.col("beam").cast("bigint").alias("beam"), F.col("chan").cast("int").alias("chan"), F.col("t").cast("bigint").alias("t"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("beam").applyInPandasWithState(
        step, "beam bigint, dm_idx int, t bigint, value double", "first bigint, chan array<bigint>, t array<bigint>, x array<double>", "append", GroupStateTimeout.NoTimeout
    )


def dedispersed(batch: DataFrame, shifts: DataFrame, size: int) -> DataFrame:
    """One batch of overlapping blocks, as dedisp.dedispersed_blocks()."""
    return dedisp.dedispersed_blocks(batch, shifts, size)
