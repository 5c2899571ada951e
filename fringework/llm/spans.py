"""Which windows of W units (bytes or words) occur more than once in a whole collection, exactly.

Every window has an anchor: the leftmost q-gram in it of least hash. Equal windows have equal
anchors at equal offsets, so windows only need to be compared with those of the same anchor, aligned
on it. Consecutive windows with one anchor travel as one span.

1. Spans are written with the anchor's hash (``key``) and a BLAKE2 digest of 128 bits over their
   content, offset and length (``mark``). Those whose key is there once hold no repeated window and go.
2. Equal spans (same mark) are counted: all windows of a span that is there twice repeat. A mark is a
   cryptographic digest, as good as the bytes; keys only bring together, a clash costs time but no result.
3. Where different spans share a key, one of each goes, with its content, to the key's bucket, where
   the caller's ``solve`` compares the windows themselves.
4. A key with more than HOT different spans is not sent to a bucket. Its spans are cut into SPLIT
   parts of fewer windows, each with a longer common core as its key, and go through 2 and 3
   again; a part of one window is nothing but its key, so this ends, and no bucket is unbounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fringework.llm.common import drop_dir, shared_dir, stored

#: Most different spans of one key that a bucket takes, and into how many parts a span of more is cut.
HOT, SPLIT = 200, 8
#: Units of a text that are looked at together; positions inside must fit into LOW bits.
CHUNK, LOW = 1 << 18, 20
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(units: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q consecutive units, by doubling."""
    h, have, power, done, done_len = units.copy(), 1, _P, None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & have:  # this power of two is part of q
                if done is None:
                    done, done_len = h, have
                else:
                    n = len(units) - done_len - have + 1
                    done = done[:n] * power + h[done_len : done_len + n]
                    done_len += have
            if have << 1 > q:
                break
            h = h[:-have] * power + h[have:]
            have, power = have << 1, power * power
        return mixed(done)


def anchored(units: np.ndarray, width: int, q: int) -> tuple[np.ndarray, ...]:
    """(start, count, offset, key) of the runs of windows that share an anchor; offset is from the first window to the anchor."""
    out = []
    span = width - q + 1
    for at in range(0, len(units) - width + 1, CHUNK):
        part = units[at : at + CHUNK + width - 1]
        g = gram_hashes(part, q)
        low = np.uint64((1 << LOW) - 1)
        packed = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        n = len(g) - span + 1
        blocks = -(-len(g) // span)
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(g)] = packed
        padded = padded.reshape(blocks, span)
        left = np.minimum.accumulate(padded, axis=1).ravel()
        right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        best = (np.minimum(right[:n], left[span - 1 : span - 1 + n]) & low).astype(np.int64)
        start = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1))
        count = np.diff(np.append(start, n))
        anchor = best[start]
        out.append((start + at, count, anchor - start, g[anchor].view(np.int64)))
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*out))


class Units:
    """How a text is cut: data, where each unit begins and ends in it, and a number for each unit."""

    def __init__(self, data: bytes, begin: np.ndarray, end: np.ndarray, numbers: np.ndarray):
        self.data, self.begin, self.end, self.numbers = data, begin, end, numbers

    def cut(self, a: int, b: int) -> bytes:
        return self.data[self.begin[a] : self.end[b - 1]] if b > a else b""


def of_bytes(text: bytes) -> Units:
    at = np.arange(len(text) + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        numbers = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * _P
    return Units(text, at[:-1], at[1:], numbers)


def of_words(text: bytes) -> Units:
    """Words without ASCII white space, joined by one space."""
    words = text.split()
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate(([0], end[:-1] + 1)) if words else end
    numbers = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return Units(b" ".join(words), begin, end, numbers)


def _mark(data: bytes, offset: int, count: int) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=offset.to_bytes(8, "little") + count.to_bytes(8, "little")).digest()


def _spans(batches, cut, width: int, q: int):
    """(row, pos, count, off, key, mark) of every span of each (row, packed)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        cols = []
        for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u = cut(unpack(packed))
            start, count, off, key = anchored(u.numbers, width, q)
            if len(start):
                marks = [_mark(u.cut(s, s + c - 1 + width), o, c) for s, c, o in zip(start.tolist(), count.tolist(), off.tolist())]
                cols.append((np.full(len(start), row), start, count, off, key, marks))
            if sum(len(c[0]) for c in cols) > 50_000:
                yield _span_batch(cols)
                cols = []
        if cols:
            yield _span_batch(cols)


def _span_batch(cols) -> pa.RecordBatch:
    row, pos, count, off, key = (np.concatenate(x) for x in list(zip(*cols))[:5])
    mark = [m for c in cols for m in c[5]]
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(pos), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(key), pa.array(mark, pa.binary())], ["row", "pos", "count", "off", "key", "mark"])


_SPAN = "row bigint, pos bigint, count int, off int, key bigint, mark binary"
_PIECE = "row bigint, pos bigint, count int, off int, key bigint, mark binary, n bigint, data binary"


def _contents(batches, cut, width: int):
    """Of (row, packed, spans): the pieces, each with its content."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[tuple] = []
        for packed, spans, row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist()):
            u = cut(unpack(packed))
            out += [(row, s["pos"], s["count"], s["off"], s["key"], s["mark"], s["n"], u.cut(s["pos"], s["pos"] + s["count"] - 1 + width)) for s in spans]
            if len(out) > 5000:
                yield _piece_batch(out)
                out = []
        if out:
            yield _piece_batch(out)


def _piece_batch(rows) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["row", "pos", "count", "off", "key", "mark", "n", "data"])


def _cut_up(batches, cut, width: int, step: int):
    """Parts of at most ``step`` windows, cut where the distance to the anchor is a multiple of it.

    A part's key is the content that all windows at these distances share, so that windows that are
    equal get equal keys even if their spans begin or end elsewhere.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(at, 256).to_pylist():
                u, off = cut(r["data"]), r["off"]
                for cell in range((off - r["count"] + 1) // step, off // step + 1):
                    a, b = max(0, off - (cell + 1) * step + 1), min(r["count"], off - cell * step + 1)
                    core = u.cut(off - cell * step, off - (cell + 1) * step + 1 + width)
                    key = int(np.uint64(xxhash.xxh64_intdigest(core, (r["key"] ^ cell) & (1 << 64) - 1)).view(np.int64))
                    data = u.cut(a, b - 1 + width)
                    out.append((r["row"], r["pos"] + a, b - a, off - a, key, _mark(data, off - a, b - a), r["n"], data))
            yield _piece_batch(out)


def by_key(batches, most: int) -> Iterator[list[dict]]:
    """Rows sorted by key, in lists of about ``most`` that never part a key."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for r in batch.slice(at, 1000).to_pylist():
                if len(held) >= most and held[-1]["key"] != r["key"]:
                    yield held
                    held = []
                held.append(r)
    if held:
        yield held


def runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, length) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


def _packed(batches, digest):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [(t or "").encode("utf-8") for t in batch.column(2).to_pylist()]
        kept = [digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in kept], pa.int64()), pa.array([h for _, h in kept], pa.string()), pa.array([pack(t) for t in texts], pa.binary())], ["row", "keep", "n_units", "whole", "packed"])


def repeats(docs: DataFrame, cut: Callable[[bytes], Units], digest: Callable[[bytes], tuple[int, str]], solve: Callable, width: int, q: int, keep: list[Column], text: str = "text") -> DataFrame:
    """(row, keep, n_units, whole, packed, found): each row of docs with the (start, count) of its repeated windows.

    keep is carried along as a struct. digest(text) gives the number of units and a digest to carry along; packed is the text, zstd.
    solve(batches) takes Arrow batches of pieces sorted by key and yields (row, pos, count) batches.
    Rows are told apart by a number of their own, so ids may be null or repeated.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("keep"), docs[text].alias("text"))
    form = T.StructType(base.schema.fields[:2]).add("n_units", T.LongType()).add("whole", T.StringType()).add("packed", T.BinaryType())
    base = stored(base.mapInArrow(lambda b: _packed(b, digest), form), folder, "base")
    spans = stored(base.where(F.col("n_units") >= width).select("row", "packed").mapInArrow(lambda b: _spans(b, cut, width, q), _SPAN), folder, "spans")
    shared = stored(spans.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), folder, "shared")
    spans = stored(spans.join(shared, "key").select("row", "pos", "count", "off", "key", "mark"), folder, "kept")
    drop_dir(spark, f"{folder}/spans")
    drop_dir(spark, f"{folder}/shared")
    one = F.struct("row", "pos", "count", "off")
    kinds = stored(spans.groupBy("key", "mark").agg(F.count("*").alias("n"), F.min(one).alias("one")), folder, "kinds")
    twice = stored(kinds.where("n > 1").select("key", "mark"), folder, "twice")
    found = [stored(spans.join(twice, ["key", "mark"]).select("row", "pos", "count"), folder, "found-0")]
    keys = stored(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), folder, "keys")
    reps = kinds.join(keys, "key").groupBy("one.row").agg(F.collect_list(F.struct("one.pos", "one.count", "one.off", "key", "mark", "n")).alias("spans"))
    pieces = base.select("row", "packed").join(reps, "row").select("row", "packed", "spans").mapInArrow(lambda b: _contents(b, cut, width), _PIECE)
    pieces = stored(pieces, folder, "pieces-0")
    level, step = 0, width - q + 1
    while True:
        sized = pieces.join(keys, "key")
        few = sized.where(F.col("kinds") <= HOT).drop("kinds")
        few = few.repartition("key").sortWithinPartitions("key")
        found.append(stored(few.mapInArrow(solve, "row bigint, pos bigint, count int"), folder, f"solved-{level}"))
        hot = keys.where(F.col("kinds") > HOT)
        if hot.isEmpty():
            break
        level, step = level + 1, -(-step // SPLIT)
        parts = stored(pieces.join(hot.select("key"), "key").mapInArrow(lambda b, step=step: _cut_up(b, cut, width, step), _PIECE), folder, f"parts-{level}")
        kinds = stored(parts.groupBy("key", "mark").agg(F.sum("n").alias("n"), F.min(F.struct("row", "pos")).alias("one")), folder, f"kinds-{level}")
        twice = stored(kinds.where("n > 1").select("key", "mark"), folder, f"twice-{level}")
        found.append(stored(parts.where("n = 1").join(twice, ["key", "mark"]).select("row", "pos", "count"), folder, f"found-{level}"))
        keys = stored(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), folder, f"keys-{level}")
        reps = stored(kinds.join(keys, "key").select("key", "mark", "n", F.col("one.row").alias("row"), F.col("one.pos").alias("pos")), folder, f"reps-{level}")
        pieces = stored(parts.drop("n").join(reps, ["key", "mark", "row", "pos"]).select("row", "pos", "count", "off", "key", "mark", "n", "data"), folder, f"pieces-{level}")
    for k in range(level + 1):  # what was found and the texts are all that is read from now on
        for name in ("kinds", "twice", "keys", "pieces", "parts", "reps"):
            drop_dir(spark, f"{folder}/{name}-{k}")
    for name in ("kept", "kinds", "twice", "keys"):
        drop_dir(spark, f"{folder}/{name}")
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    by_row = all_found.groupBy("row").agg(F.collect_list(F.struct("pos", "count")).alias("found"))
    return base.join(by_row, "row", "left")


def covered(found: list[dict] | None, n: int, width: int) -> np.ndarray:
    """Which of n units lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for f in found or []:
        edge[f["pos"]] += 1
        edge[f["pos"] + f["count"] - 1 + width] -= 1
    return np.cumsum(edge[:-1]) > 0
