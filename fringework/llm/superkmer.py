"""Exact removal of repeated word windows, by super-k-mer partitioning.

Consecutive windows that share a minimiser travel to its bucket as one packed string of words. In
the bucket each string is opened into its windows, and sorting them brings equal ones together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from fringework.llm import spans

WIDTH, GRAM = 35, 8
#: Strings that are opened at once, about; more only if one key needs it, and never above this plus spans.HOT.
BATCH = 2000


def repeated(rows: list[dict], width: int) -> list[tuple[int, int, int]]:
    """(row, pos, count) of the repeated windows in strings sorted by key; those with n > 1 only serve as partners."""
    windows = []
    for i, r in enumerate(rows):
        u = spans.of_words(r["data"])
        windows += [(u.cut(k, k + width), i, k) for k in range(r["count"])]
    windows.sort()
    hits: dict[int, list[int]] = {}
    for j, (window, i, k) in enumerate(windows):
        if (j and windows[j - 1][0] == window) or (j + 1 < len(windows) and windows[j + 1][0] == window):
            hits.setdefault(i, []).append(k)
    return [(rows[i]["row"], rows[i]["pos"] + k, 1) for i, ks in hits.items() if rows[i]["n"] == 1 for k in ks]


def _solve(width: int):
    def run(batches):
        for rows in spans.by_key(batches, BATCH):
            if found := repeated(rows, width):
                row, pos, count = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(pos, pa.int64()), pa.array(count, pa.int32())], ["row", "pos", "count"])

    return run


def _digest(text: bytes) -> tuple[int, str]:
    words = text.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def digests(docs: DataFrame, width: int = WIDTH, q: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs.

    A word goes if a window of ``width`` words that covers it begins anywhere else too, in the same
    text or another. Null texts have no words. Rows with equal or null ids are texts of their own.
    Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, n, whole, packed, found in zip(*(c.to_pylist() for c in batch.columns)):
                if found is None:
                    out.append((doc, n, 0, whole))
                else:
                    gone = spans.covered(found, n, width)
                    rest = b" ".join(w for w, g in zip(zstandard.decompress(packed).split(), gone.tolist()) if not g)
                    out.append((doc, n, int(gone.sum()), hashlib.sha256(rest).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = spans.repeats(docs, spans.of_words, _digest, _solve(width), width, q, [docs[doc_id].cast("bigint").alias("doc_id")], text)
    return found.select("keep.doc_id", "n_units", "whole", F.when(F.col("found").isNotNull(), F.col("packed")).alias("packed"), "found").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )
