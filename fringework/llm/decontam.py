"""Benchmark decontamination by the q-gram lemma.

An item of m bytes that stands in a text with at most e edits leaves at least m + 1 - q(e + 1) of its
q-grams as they are, all on diagonals (place in the text less place in the item) that lie at most e
apart. So hits are counted in bands of 2(e + 1) diagonals that overlap by half; bands with enough
different q-grams are verified by an alignment that stays inside the band.

Items of under 2 Q bytes are too short for grams of that length: from SHORT bytes on they have an index
with grams of SHORT bytes (at 20 bytes one edit is allowed, and two such grams fit beside it). Below SHORT
bytes an item is its own gram. Such short strings stand inside longer words by chance, so they only count
where neither end lies inside a word.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fringework.llm.spans import gram_hashes

Q, RATE, SHORT = 12, 0.05, 8
#: Bytes of a text that are looked at together, unless items are longer, and hits that are held at once.
WINDOW, HELD = 1 << 18, 1 << 21
#: Bytes of normalised items that are sent to the executors at once; more items go through in blocks of about this size.
BLOCK_BYTES = 8 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_BITS = 22


def normal(text: str | None) -> bytes:
    """Lower case, runs of white space as one space, none at the ends; UTF-8."""
    return _SPACE.sub(b" ", (text or "").lower().encode("utf-8", "ignore")).strip(b" ")


def budget(m: int, rate: float = RATE) -> int:
    """Most edits for an item of m bytes: its share, rounded down."""
    return int(m * rate)


def gram_length(m: int, q: int = Q, rate: float = RATE) -> int:
    """Length of the grams that find an item of m bytes; the lemma must leave at least one of them."""
    for length in (q, min(q, SHORT)):
        if m >= 2 * length * (length == q) and m + 1 - length * (budget(m, rate) + 1) >= 1:
            return length
    return max(1, m // (budget(m, rate) + 1))


def _grams(data: bytes, q: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return gram_hashes(x, q) if len(x) >= q else np.empty(0, np.uint64)


def align(item: bytes, region: bytes, most: int) -> int | None:
    """Least edits between the item and any part of the region, if at most ``most``; region's length bounds the band."""
    if item in region:
        return 0
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    wide = len(b) + 2 * most - len(a) + 1
    if wide < 1:
        return None
    far = len(a) + len(b) + 1
    step = np.arange(wide)
    b = np.concatenate((np.zeros(most, np.int16) - 1, b.astype(np.int16), np.zeros(most + 1, np.int16) - 1))  # -1 equals nothing
    row = np.where((step >= most) & (step <= wide - 1), 0, far)  # cell k of row i is place i + k - most in the region
    for i in range(len(a)):
        new = row + (b[i : i + wide] != a[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - step) + step
        if new.min() > most:
            return None
        row = new
    least = int(row.min())
    return least if least <= most else None


def _word(byte: int) -> bool:
    """Letters and digits; any byte of a character beyond ASCII counts as one."""
    return byte > 127 or chr(byte).isalnum()


class Items:
    """An index of the items' q-grams; one for each length of grams."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, rate: float = RATE):
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, t in items:
            if t:
                groups.setdefault(gram_length(len(t), q, rate), []).append((i, t))
        self.groups = [_Grams(group, length, rate) for length, group in sorted(groups.items())]

    def find(self, text: bytes) -> list[tuple[int, int]]:
        """(item_id, edits) of the items that stand in a normalised text; an item once, with its fewest edits."""
        return [x for group in self.groups for x in group.find(text)]


class _Grams:
    def __init__(self, items: list[tuple[int, bytes]], q: int, rate: float):
        self.q, self.items = q, items
        sizes = [len(t) for _, t in items]
        self.edits = np.array([budget(m, rate) for m in sizes], np.int64)
        self.least = np.array([m + 1 - q * (e + 1) for m, e in zip(sizes, self.edits.tolist())], np.int64)
        self.reach = max(sizes) + int(self.edits.max())
        grams = [_grams(t, q) for _, t in items]
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        self.gram, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(grams)), [len(x) for x in grams])[order]
        self.at = np.concatenate([np.arange(len(x)) for x in grams]).astype(np.int64)[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.gram >> np.uint64(64 - _BITS)] = True

    def find(self, text: bytes) -> list[tuple[int, int]]:
        best: dict[int, int] = {}
        step = max(WINDOW, self.reach)
        for at in range(0, max(1, len(text) - self.reach), step):  # windows overlap by the longest match
            end = at + step + self.reach + 1  # and show a byte more on either side
            self._window(text[max(0, at - 1) : end], best, int(at > 0), int(end < len(text)))
        return [(self.items[k][0], e) for k, e in sorted(best.items())]

    def _hits(self, place: np.ndarray, slot: np.ndarray):
        """(item, place in the item, diagonal) of all hits, about HELD at a time."""
        n = self.count[slot]
        cuts = np.searchsorted(np.cumsum(n), np.arange(HELD, int(n.sum()), HELD)) if len(n) else []
        for a, z in zip([0, *cuts], [*cuts, len(n)]):
            if a < z:
                m = n[a:z]
                which = np.repeat(self.first[slot[a:z]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                i = self.at[which]
                yield self.of[which], i, np.repeat(place[a:z], m) - i

    def _window(self, text: bytes, best: dict[int, int], before: int, after: int) -> None:
        g = _grams(text, self.q)
        place = np.flatnonzero(self.bits[g >> np.uint64(64 - _BITS)])
        if not len(place):
            return
        slot = np.minimum(np.searchsorted(self.gram, g[place]), len(self.gram) - 1)
        real = self.gram[slot] == g[place]
        place, slot = place[real], slot[real]
        total = np.zeros(len(self.items), np.int64)
        for item, _, _ in self._hits(place, slot):
            total += np.bincount(item, minlength=len(self.items))
        enough = total >= self.least  # before bands: hits anywhere
        if not enough.any():
            return
        w = self.edits + 1
        found = np.empty((3, 0), np.int64)  # item, band, place in the item; a q-gram counts once in a band
        for item, i, diagonal in self._hits(place, slot):
            use = enough[item]
            item, i, diagonal = item[use], i[use], diagonal[use]
            band = diagonal // w[item]  # band b holds diagonals from b * w to b * w + 2 * w - 1
            new = np.stack((np.concatenate((item, item)), np.concatenate((band, band - 1)), np.concatenate((i, i))))
            found = np.unique(np.concatenate((found, new), axis=1), axis=1)
        edge = np.flatnonzero(np.diff(found[0], prepend=-1))
        for a, z in zip(edge, [*edge[1:], found.shape[1]]):
            k = int(found[0, a])
            e = self._bands(k, found[1, a:z], text, best.get(k), before, len(text) - after)
            if e is not None:
                best[k] = e

    def _bands(self, k: int, band: np.ndarray, text: bytes, best: int | None, low: int, high: int) -> int | None:
        """Fewest edits of item k in its bands, if fewer than best. Bytes before low and from high on only show borders."""
        data, most = self.items[k][1], int(self.edits[k])
        w, least = most + 1, None
        bands, hits = np.unique(band, return_counts=True)
        for b in bands[hits >= self.least[k]].tolist():
            if 0 in (best, least):
                break
            if len(data) < SHORT and not most:  # a diagonal of the band is a match if its bytes are equal
                for a in (b, b + 1):
                    z = a + len(data)
                    if low <= a and z <= high and text[a:z] == data and not (a and _word(text[a - 1]) and _word(data[0])) and not (z < len(text) and _word(text[z]) and _word(data[-1])):
                        least = 0
                continue
            a = max(0, b * w - most)
            fewer = min(x for x in (most, None if best is None else best - 1, None if least is None else least - 1) if x is not None)
            e = align(data, text[a : max(a, b * w + 2 * w + len(data) + most)], fewer)
            least = e if e is not None else least
        return least


def _blocks(benchmark: DataFrame, text: str, item_id: str):
    """The items in blocks of about BLOCK_BYTES, each brought to the driver by itself."""
    rows = benchmark.select(benchmark[item_id].cast("bigint").alias("item_id"), benchmark[text].alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n):
        yield [(r.item_id, normal(r.text)) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toLocalIterator()]


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, edits): a row for each item that stands in a row of docs with at most ``rate`` of its bytes edited.

    Both are normalised first. The share is rounded down, so items of under 20 bytes have to stand there as
    they are, those of under SHORT bytes also with no letter or digit next to one of their own at either end.
    Null and empty texts hold nothing and null or empty items are nowhere; null ids are carried along; repeated
    rows, and repeated items, are found as often as they are there. A very long text is looked at in windows.
    The documents are passed over once for each block of items.
    """
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    out = None
    for items in _blocks(benchmark, text if text in benchmark.columns else "text", item_id):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Items(sent.value, q, rate)
            for batch in batches:
                found = [(d, i, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, e in index.find(normal(t))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["doc_id", "item_id", "edits"])

        part = rows.mapInArrow(run, "doc_id bigint, item_id bigint, edits bigint")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs without the rows whose text holds an item; found as in leaks(). No shuffle."""
    at = docs.columns.index(text)
    for items in _blocks(benchmark, "text", item_id):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Items(sent.value, q, rate)
            for batch in batches:
                yield batch.filter(pa.array([not index.find(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
