"""Near copies by exact Jaccard similarity of their sets of five-word shingles.

Two sets of x and y hashes with a similarity of 0.8 or more lack at most x // 5 and y // 5 of each
other. So whatever order all hashes are put in, the first x // 5 + k and y // 5 + k of them have at
least k in common. A set is listed under each of these; pairs that stand together in short lists and
could reach k lists are verified on the whole sets. Hashes that many sets have come last in the order,
and a list that is long even so is never gathered in one place: its rows are joined, for pairs that no
short list has. Their first common hash is in a long list, and if it is at i in one set and at j in the
other (from 0), they have x - i and y - j hashes at most in common, which must be 4 / 9 of x + y. So only
rows near the front of their sets meet, and those are mostly linked before, by three sets of each list,
twice. Nothing is left to chance, and no list is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fringework.llm.common import drop_dir, shared_dir, stored
from fringework.llm.components import KEY, components, first_of_each, keyed

WORDS = 5
#: Lists of more sets are long. Of the hashes that so many sets have, so many at most are put last: a matter of cost, any order is exact.
LONG, LAST = 64, 1 << 17
#: Which hashes many sets have is found on the whole sets of one text of so many (by hash). All texts are listed and compared.
SAMPLE = 8
#: Most hashes with a long list that are broadcast (8 bytes each); more are joined by a shuffle.
SENT = 1 << 20
#: Texts to verify are picked by so many slots of their hash, then by equality.
SLOTS = 1 << 22


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes in ascending order (signed); texts of fewer words have one shingle, without a word none."""
    parts = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, np.int64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(parts) - words + 1, xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b]) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], np.uint64, n)
    return np.unique(h.view(np.int64))


def _node(h: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(h.tobytes())
    return n - (1 << 64) if n >> 63 else n


def _first(h: np.ndarray, last: np.ndarray | None, rank: np.ndarray | None) -> np.ndarray:
    """The first n // 5 + k of n hashes; those in last (ascending) come after all others, by rank. All hashes if last is None."""
    if last is None:
        return h
    most = len(h) // 5 + _k(len(h))
    if len(last) and len(h):
        at = np.minimum(np.searchsorted(last, h), len(last) - 1)
        h = h[np.argsort(np.where(last[at] == h, rank[at] + 1, 0), kind="stable")]
    return h[:most]


def _k(n: int) -> int:
    return max(1, n // 10) if n else 0


def _listed(rows: DataFrame, last: np.ndarray | None, rank: np.ndarray | None, sketch=None) -> DataFrame:
    """(_null, _id, _hash, node, n, fp, first) for each row of rows(_null, _id, _hash, text); fp is what sketch gives, or null."""
    sent = rows.sparkSession.sparkContext.broadcast((last, rank))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(t) for t in batch.column(3).to_pylist()]
                first = [_first(h, *sent.value) for h in sets]
                off = np.cumsum([0, *map(len, first)]).astype(np.int32)
                fp = pa.nulls(len(sets), pa.int64()) if sketch is None else pa.array(np.array([sketch(h) for h in sets], np.uint64).view(np.int64))
                cols = [pa.array([_node(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), fp, pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(first)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], [*KEY, "node", "n", "fp", "first"])

    return rows.mapInArrow(run, "_null boolean, _id bigint, _hash bigint, node bigint, n int, fp bigint, first array<bigint>")


def _pairs(batches):
    """(a, b, k, m) for the sets of each short list whose sizes allow 0.8; k lists must have both."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch, out = whole.slice(at, 512), []
            for m, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                node, n = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
                order = np.argsort(node)
                node, n = node[order], n[order].astype(np.int64)
                x, y = np.triu_indices(len(node), 1)
                ok = 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
                x, y = x[ok], y[ok]
                out.append((node[x], node[y], np.maximum(1, np.minimum(n[x], n[y]) // 10), np.full(len(x), m, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "k", "m"])


def _verified(pairs: DataFrame, best: DataFrame, rows: DataFrame, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. best: (node, best) names a row of rows for each node."""
    pairs = stored(pairs, folder, f"{name}-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = stored(needed.join(best.hint("merge"), "node").select("node", F.col("best._hash").alias("_hash")), folder, f"{name}-needed")
    slots = np.zeros(SLOTS, bool)
    for r in needed.select(F.pmod("_hash", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toLocalIterator():
        slots[r.slot] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(slots, bitorder="little"))

    def sets(batches):
        for batch in batches:
            slot = np.mod(batch.column(0).to_numpy(zero_copy_only=False), SLOTS)
            at = np.flatnonzero(sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            for k in range(0, len(at), 256):
                found = [shingles(t) for t in batch.column(1).take(pa.array(at[k : k + 256])).to_pylist()]
                off = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in found], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(found)))], ["node", "hashes"])

    s = rows.select("_hash", "text").mapInArrow(sets, "node bigint, hashes array<bigint>").join(needed.select("node").hint("merge"), "node")
    s = stored(s.groupBy("node").agg(F.first("hashes").alias("hashes")), folder, f"{name}-sets")
    both = pairs.join(s.select(F.col("node").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a").join(s.select(F.col("node").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")
    similar = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))  # |x and y| / |x or y| >= 0.8
    out = stored(both.where(similar).select("a", "b"), folder, f"{name}-links")
    for x in ("pairs", "needed", "sets"):
        drop_dir(rows.sparkSession, f"{folder}/{name}-{x}")
    return out


def _room(n: str, pos: str) -> str:
    """SQL: 4 times the size of the largest set that a set of n hashes can be similar to if pos of them are not in it."""
    return f"(5 * {n} - 9 * {pos})"


def _fits(x: str, y: str) -> str:
    """SQL: what the columns n and pos of x and y, of a hash that is their first in common, leave room for."""
    n, pos = (lambda s: s + "n"), (lambda s: s + "pos")
    return f"4 * {n(x)} <= {_room(n(y), pos(y))} and 4 * {n(y)} <= {_room(n(x), pos(x))}"


def _stars(held: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of each set of held(token, node, n, pos, deg, root) with three of its list, if they have other roots and fit."""
    by = lambda x: F.struct(x.alias("by"), "node", "n", "pos", "root")
    hubs = [F.max(by(F.col("deg"))), *(F.min(by(F.xxhash64("node", F.lit(seed + k)))) for k in range(2))]
    rows = held.join(held.groupBy("token").agg(F.array(*hubs).alias("hubs")), "token").select("node", "n", "pos", "root", F.explode("hubs").alias("hub"))
    rows = rows.where(f"hub.root <> root and {_fits('', 'hub.')}")
    return rows.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()


def _rooted(held: DataFrame, known: DataFrame) -> DataFrame:
    """held with the roots that known(node, root) gives."""
    known = known.select(F.col("node").alias("_node"), F.col("root").alias("_root")).hint("merge")
    return held.join(known, F.col("node") == F.col("_node"), "left").select("token", "node", "n", "pos", "deg", F.coalesce("_root", "node").alias("root"))


def _apart(held: DataFrame) -> DataFrame:
    """The rows of held that may be near a set of another root in the same list.

    One set of such a pair has the hash in its first ninth (is early). So a later row stays only if there are early ones
    of another root, the least of them small enough and one with room enough; and a list of one root goes.
    """
    early = held.where("early").groupBy("token").agg(F.min("n").alias("least"), F.max(F.expr(_room("n", "pos"))).alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    held = held.join(early, "token").where(f"early or (low <> root or high <> root) and 4 * least <= {_room('n', 'pos')} and 4 * n <= most").select(held.columns)
    lists = held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return held.join(lists, "token")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sketch=None, close=None) -> DataFrame:
    """One row of each class of docs, with all its columns: the one with the smallest doc_id, null ids last.

    Linked are texts whose sets of five-word shingles (A-Z in lower case, single spaces) have a Jaccard
    similarity of 0.8 or more; a class is what links connect. Null and blank texts have no shingle and are
    one class. Rows that share an id are told apart by their text; of rows alike in both one stays.
    sketch(hashes) gives each set's fingerprint and close() pairs (a, b) of sets(node, n, fp) that may be similar:
    they are verified and linked first, which changes the cost, not the result.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    named = keyed(docs, text, doc_id)
    rows = named.select(*KEY, docs[text].cast("string").alias("text"))
    some = rows.where(F.pmod(F.xxhash64("_hash"), F.lit(SAMPLE)) == 0)
    often = _listed(some, None, None).select(F.explode("first").alias("token")).groupBy("token").count().where(F.col("count") > max(1, LONG // SAMPLE))
    often = often.orderBy(F.desc("count"), "token").limit(LAST).collect()
    last, rank = np.array([r.token for r in often], np.int64), np.arange(len(often), 0, -1)  # the commonest at the very end
    order = np.argsort(last)
    listed = stored(_listed(rows, last[order], rank[order], sketch), folder, "listed")
    own = stored(listed.select(*KEY, "node"), folder, "own")
    best = stored(own.groupBy("node").agg(F.min(F.struct(*KEY)).alias("best")), folder, "best")
    nodes = stored(listed.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("first").alias("first")), folder, "nodes")
    drop_dir(spark, f"{folder}/listed")
    alike = spark.createDataFrame([], "a bigint, b bigint")
    if close:
        alike = _verified(close(nodes.select("node", "n", "fp")), best, rows, folder, "alike")

    tokens = nodes.select("node", "n", F.posexplode("first").alias("pos", "token"))
    often = stored(tokens.groupBy("token").count().where(F.col("count") > LONG).select("token"), folder, "often")
    often = F.broadcast(often) if often.count() <= SENT else often.hint("merge")
    lists = tokens.join(often, "token", "left_anti").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("list")).where(F.size("list") > 1)  # LONG sets at most
    lists = stored(lists.groupBy("list").agg(F.count("*").alias("m")), folder, "lists")
    # long lists stay rows; of those with the same members one is looked at, the first in the order, which is first in each set
    long = stored(tokens.join(often, "token"), folder, "long")
    kinds = long.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("pos").alias("pos"))
    kinds = kinds.groupBy("c", "x", "y").agg(F.min(F.struct("pos", "token")).alias("t")).select("t.token")
    degree = stored(long.groupBy("node").agg(F.count("*").alias("deg")), folder, "degree")
    long = stored(long.join(kinds, "token").where("5 * pos <= n"), folder, "members")  # no set has room for later ones
    drop_dir(spark, f"{folder}/long")
    # what copies have been made of is in most of their lists: the others of a list are compared with that set and two more
    # first, and those that this leaves apart with three of them, since what is linked need not be compared any more
    held = long.join(degree.hint("merge"), "node").withColumn("root", F.col("node"))
    held = stored(_rooted(held, components(alike, f"{folder}/alike")), folder, "held-0")
    star = alike.unionByName(_verified(_stars(held, 0), best, rows, folder, "star-0"))
    held = stored(_rooted(held, components(star, f"{folder}/stars-0")), folder, "held-1")
    first = held.groupBy("token").agg(F.max(F.struct("deg", "node", "root")).alias("top")).select("token", F.col("top.root").alias("main"))
    star = star.unionByName(_verified(_stars(held.join(first, "token").where("root <> main").select(held.columns), 2), best, rows, folder, "star-1"))
    rooted = components(star, f"{folder}/stars-1")
    held = stored(_rooted(held, rooted), folder, "held-2")
    held = stored(_apart(held.withColumn("early", F.expr("9 * pos <= n"))), folder, "held-3")
    for name in ("members", "held-0", "held-1", "held-2", "alike", "stars-0"):
        drop_dir(spark, f"{folder}/{name}")

    x, y = (held.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "pos", "root", "early")]) for side in "xy")
    far = x.where("x_early").join(y.hint("merge"), "token").where(f"x_root <> y_root and (x_node < y_node or not y_early) and {_fits('x_', 'y_')}")
    far = far.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    pairs = lists.select("m", "list").mapInArrow(_pairs, "a bigint, b bigint, k bigint, m bigint")
    pairs = stored(pairs.groupBy("a", "b").agg(F.sum("m").alias("m"), F.first("k").alias("k")), folder, "short")
    # what is short of k lists may be together in as many long ones as both are in
    both = lambda side: degree.select(F.col("node").alias(side), F.col("deg").alias(f"{side}_deg")).hint("merge")
    more = pairs.where("m < k").join(both("a"), "a").join(both("b"), "b").where("m + least(a_deg, b_deg) >= k")
    pairs = pairs.where("m >= k").select("a", "b").unionByName(more.select("a", "b")).unionByName(far).distinct()
    for side in "ab":  # linked before
        known = rooted.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")).hint("merge")
        pairs = pairs.join(known, side, "left")
    pairs = pairs.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
    near = _verified(pairs, best, rows, folder, "near")

    roots = stored(components(star.unionByName(near), f"{folder}/all"), folder, "roots")
    out = first_of_each(named, own, roots, folder).select(docs.columns)
    for name in ("own", "best", "nodes", "often", "lists", "degree", "short", "stars-1", "held-3", "alike-links", "star-0-links", "star-1-links", "near-links", "roots", "all"):
        drop_dir(spark, f"{folder}/{name}")
    return out
