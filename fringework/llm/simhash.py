"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most ``bits`` bits, cut into ``bits // 2 + 1`` segments, have a
segment in which they differ by at most one bit. Each segment is indexed once for every bit that
is taken out of it (a wildcard); fingerprints that share such a variant are candidates, found by an
equality join, and verified on all 64 bits. Equal fingerprints are joined up before that, so a
group of copies of any size takes part as one row.

near_copies() takes sets of five-word shingles for that, verifies what shares a variant on the whole
sets, and has the links that fingerprints do not show from jaccard.keep_one(), which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fringework.llm import jaccard
from fringework.llm.common import drop_dir, shared_dir, stored
from fringework.llm.components import KEY, components, first_of_each, keyed

#: Buckets of up to so many fingerprints are verified by all bits at once; larger ones by midpoints.
SMALL_BUCKET = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if over half of the shingles' hashes have it. No word: zero."""
    parts = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    h = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], "<u8", n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """64 bits; a bit is set if over half of the 64-bit hashes have it."""
    h, total = h.view("<u8"), np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp bigint holding the 64 bits) for each row; a null text counts as empty."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                fp = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _segments(bits: int) -> list[tuple[int, int]]:
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def variants(nodes: DataFrame, bits: int) -> DataFrame:
    """The columns of nodes(fp, ...), slot and key: 64 rows for each. slot is the bit that is left out, key its segment without it."""
    slot = F.col("slot")
    low, width = F.lit(0), F.lit(0)
    for a, b in _segments(bits):
        inside = (slot >= a) & (slot < b)
        low, width = F.when(inside, a).otherwise(low), F.when(inside, b - a).otherwise(width)
    out = nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    out = out.select("*", low.alias("low"), width.alias("width"))
    # shifting up and down again clears what lies outside the segment
    segment = "shiftrightunsigned(shiftleft(fp, 64 - low - width), 64 - width)"
    return out.select(*nodes.columns, "slot", F.expr(f"{segment} & ~shiftleft(1L, slot - low)").alias("key"))


def _verified(batches, bits: int):
    """Links of each bucket: every member to the smallest one it reaches inside the bucket."""
    for batch in batches:
        lists = batch.column(0)
        flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
        size = np.diff(off)
        a, b = [], []
        for n in np.unique(size):
            at = off[:-1][size == n]
            for k in range(0, len(at), max(1, (1 << 20) // int(n * n))):
                group = np.sort(flat[at[k : k + max(1, (1 << 20) // int(n * n))][:, None] - off[0] + np.arange(n)], axis=1)
                u = group.view(np.uint64)
                linked = np.bitwise_count(u[:, :, None] ^ u[:, None, :]) <= bits
                label = np.broadcast_to(np.arange(n), group.shape)
                while True:
                    new = np.where(linked, label[:, None, :], n).min(axis=2)
                    if (new == label).all():
                        break
                    label = new
                moved = label != np.arange(n)
                a.append(group[moved])
                b.append(np.take_along_axis(group, label, axis=1)[moved])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def links(nodes: DataFrame, folder: str, bits: int = 2) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints of nodes(fp) to connect all that differ in <= bits bits.

    A bucket of two is one comparison. A bucket of up to SMALL_BUCKET is verified as a whole in one
    row. Members of a larger bucket are dealt out again, once for each fingerprint whatever the
    number of its large buckets: by the fingerprints half way, which both ends of a link share.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be from 0 to 3: more would need segments too short to tell many documents apart")
    # dealt out by number: a table of fingerprints is a file or two, and 64 rows come of each
    v = variants(nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"), bits)
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= bits
    buckets = stored(v.groupBy("slot", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), folder, "buckets")
    pairs = buckets.where("n = 2").where(near("a", "b")).select("a", "b")
    more = stored(v.join(buckets.where("n > 2").select("slot", "key", "n").hint("merge"), ["slot", "key"]).select("slot", "key", "n", "fp"), folder, "members")
    small = (
        more.where(F.col("n") <= SMALL_BUCKET).groupBy("slot", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        .mapInArrow(lambda batches: _verified(batches, bits), "a bigint, b bigint")
    )
    out = pairs.unionByName(small)
    large = more.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    return out.unionByName(midpoint_links(large, bits)).distinct()


def midpoint_links(nodes: DataFrame, bits: int) -> DataFrame:
    """Links among many fingerprints: two that differ in <= bits bits share one at most bits/2 from either (rounded up)."""
    ball = nodes.select("fp", F.col("fp").alias("mid"))
    for _ in range((bits + 1) // 2):
        flips = ball.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("flip"), "mid")
        flipped = F.col("mid").bitwiseXOR(F.expr("shiftleft(1L, greatest(flip, 0))"))
        ball = flips.select("fp", F.when(F.col("flip") < 0, F.col("mid")).otherwise(flipped).alias("mid"))
    if bits > 2:
        ball = ball.distinct()
    fps = ball.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    if bits == 3:  # two that share a midpoint may differ in 4 bits
        return fps.mapInArrow(lambda batches: _verified(batches, bits), "a bigint, b bigint")
    return fps.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")


def classes(docs: DataFrame, words: int = 3, bits: int = 2, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for each row of docs.

    Linked are fingerprints that differ in at most ``bits`` bits; component_id is the smallest
    doc_id reachable. Null and empty texts have the fingerprint zero and are linked like others.
    Repeated rows come out as often as they come in; a row without doc_id gets its component's id,
    null if no member has one. Other columns are ignored. An empty table gives an empty result.
    """
    folder = shared_dir(docs.sparkSession)
    own = stored(fingerprints(docs, words, seed, text, doc_id), folder, "fingerprints")
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), folder, "nodes")
    roots = stored(components(links(nodes.select("fp"), folder, bits), f"{folder}/stars"), folder, "roots")
    rooted = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), folder, "rooted")
    lowest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), folder, "lowest")
    classed = stored(rooted.join(lowest, "root").select("fp", "component_id"), folder, "classes")
    for name in ("nodes", "buckets", "members", "stars", "roots", "rooted", "lowest"):
        drop_dir(docs.sparkSession, f"{folder}/{name}")
    return own.join(classed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class of classes(), with all its columns: the smallest doc_id, null ids last.

    Rows that share an id are told apart by their text; of rows alike in both one stays.
    """
    folder = shared_dir(docs.sparkSession)
    named = keyed(docs, text, doc_id)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                fp = np.array([fingerprint(t, words, seed) for t in batch.column(3).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp)], [*KEY, "node"])

    own = stored(named.select(*KEY, docs[text].cast("string").alias("text")).mapInArrow(run, "_null boolean, _id bigint, _hash bigint, node bigint"), folder, "own")
    nodes = stored(own.select(F.col("node").alias("fp")).distinct(), folder, "nodes")
    roots = stored(components(links(nodes, folder, bits), f"{folder}/stars"), folder, "roots")
    out = first_of_each(named, own, roots, folder).select(docs.columns)
    for name in ("own", "nodes", "buckets", "members", "stars", "roots"):
        drop_dir(docs.sparkSession, f"{folder}/{name}")
    return out


def variant_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets of sets(node, n, fp) that stand side by side in a bucket of a variant, or first in it, if their sizes allow 0.8.

    A bucket is one half of a fingerprint but for one bit. It is put in order of size and never gathered: it gives
    two pairs for each of its rows, however many they are. Sets are told apart by node, so equal fingerprints meet too.
    """
    # dealt out by number, as in links()
    v = variants(sets.select("node", "n", "fp").repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"), 2)
    v = v.select("node", "n", F.expr("shiftleft(cast(slot as bigint), 32) | key").alias("key"))  # halves have 32 bits
    bucket = Window.partitionBy("key").orderBy("n", "node")
    both = lambda f: f(F.struct("node", "n")).over(bucket)
    v = v.select("node", "n", both(F.lag).alias("before"), both(F.first).alias("head")).where("before is not null")
    v = v.select("node", "n", F.explode(F.array("before", "head")).alias("with")).where("5 * with.n >= 4 * n and with.node <> node")
    return v.select(F.least("node", "with.node").alias("a"), F.greatest("node", "with.node").alias("b")).distinct()


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Each set of shingles has a fingerprint; sets that share a deletion variant are verified and linked first.
    Texts of that similarity differ in some ten of 64 bits, so many of them share none: jaccard.keep_one() finds
    the links that are left between different classes. It has the rules for nulls and ties.
    """
    return jaccard.keep_one(docs, text, doc_id, sketch=majority, close=variant_pairs)
