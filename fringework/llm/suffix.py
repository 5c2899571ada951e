"""Exact removal of repeated byte strings, by column-wise construction over many texts at once.

Texts that share an anchor stand under each other, aligned on it. From the last column to the first,
each round inserts one symbol of every text: the order of the suffixes that begin in this column
comes from the order of those that begin in the next one, by a stable sort on the new symbol (the
column of the Burrows-Wheeler transform), and the common prefixes of neighbours are carried along.
Where a common prefix reaches the window's length, both neighbours hold a repeated window. Since
equal windows are aligned, suffixes of different columns need not be put in order, and a round costs
as much as it inserts. A batch's columns are read in sequence from memory: its texts are few and short
by bound, so the external files are the sorted tables of pieces on shared storage that batches come from.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from fringework.llm import spans

WIDTH, GRAM = 400, 128
#: Texts of one round's column, about; more only if one key needs it, and never above this plus spans.HOT.
BATCH = 4000
_NONE = 256


def repeated(rows: list[dict], width: int) -> list[tuple[int, int, int]]:
    """(row, pos, count) of the repeated windows in pieces sorted by key; those with n > 1 only serve as partners."""
    m = len(rows)
    size = np.array([len(r["data"]) for r in rows])
    off = np.array([r["off"] for r in rows])
    begin = off.max() - off
    end = begin + size
    columns = int(end.max())
    table = np.full((columns, m), _NONE, np.uint16)
    for i, r in enumerate(rows):
        table[begin[i] : end[i], i] = np.frombuffer(r["data"], np.uint8)
    keys = np.array([r["key"] for r in rows])
    group = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1]))).astype(np.uint16 if m < 1 << 16 else np.int64)
    hit = np.zeros((columns, m), bool)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    for column in range(columns - 1, -1, -1):
        symbol = table[column][order]
        by = np.argsort(symbol, kind="stable")
        by = by[np.argsort(group[by], kind="stable")]
        symbol, order = symbol[by], order[by]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (group[1:] == group[:-1]) & (symbol[1:] != _NONE))
        new = np.zeros(m + 1, np.int32)
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[::2], ends[1::2] = by[same] + 1, by[same + 1] + 1
            new[same + 1] = np.minimum.reduceat(common, ends)[::2] + 1
        common = new
        at = np.flatnonzero(common >= width)
        if len(at):
            hit[column, order[at]] = True
            hit[column, order[at - 1]] = True
    out = []
    for i, r in enumerate(rows):
        if r["n"] == 1:
            out += [(r["row"], r["pos"] + s, c) for s, c in spans.runs(hit[begin[i] : begin[i] + r["count"], i])]
    return out


def _solve(width: int):
    def run(batches):
        for rows in spans.by_key(batches, BATCH):
            if found := repeated(rows, width):
                row, pos, count = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(pos, pa.int64()), pa.array(count, pa.int32())], ["row", "pos", "count"])

    return run


def _digest(text: bytes) -> tuple[int, str]:
    return len(text), hashlib.sha256(text).hexdigest()


def _rest(packed: bytes, found, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    gone = spans.covered(found, n, width)
    return np.frombuffer(zstandard.decompress(packed), np.uint8)[~gone], gone


def _found(docs: DataFrame, width: int, q: int, keep, text: str) -> DataFrame:
    return spans.repeats(docs, spans.of_bytes, _digest, _solve(width), width, q, keep, text)


def digests(docs: DataFrame, width: int = WIDTH, q: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    A byte goes if a string of ``width`` bytes that covers it begins anywhere else too, in the same
    text or another. Null texts count as empty. Rows with equal or null ids are texts of their own.
    Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, n, whole, packed, found in zip(*(c.to_pylist() for c in batch.columns)):
                if found is None:
                    out.append((doc, n, 0, 0, whole))
                else:
                    rest, gone = _rest(packed, found, n, width)
                    out.append((doc, n, int(gone.sum()), len(list(spans.runs(gone))), hashlib.sha256(rest.tobytes()).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _found(docs, width, q, [docs[doc_id].cast("bigint").alias("doc_id")], text)
    return found.select("keep.doc_id", "n_units", "whole", F.when(F.col("found").isNotNull(), F.col("packed")).alias("packed"), "found").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def cut(docs: DataFrame, width: int = WIDTH, q: int = GRAM, text: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of each text; bytes of a character that was cut in two go with it.

    No row goes, even if its whole text does; null texts become empty. Columns keep names and order.
    """

    def run(batches):
        for batch in batches:
            out = []
            for n, packed, found in zip(*(c.to_pylist() for c in batch.columns[1:])):
                out.append(zstandard.decompress(packed).decode() if found is None else _rest(packed, found, n, width)[0].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["keep", "_text"])

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    keep = [plain[n] for n, c in zip(names, docs.columns) if c != text]
    own = names[docs.columns.index(text)]
    found = _found(plain, width, q, keep or [plain[own].isNull().alias("none")], own).select("keep", "n_units", "packed", "found")
    kept = found.mapInArrow(run, found.select("keep", F.lit("").alias("_text")).schema)
    return kept.select(*[(F.col("_text") if n == own else F.col(f"keep.{n}")).alias(c) for n, c in zip(names, docs.columns)])
