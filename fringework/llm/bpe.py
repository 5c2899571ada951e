"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token with which the piece's encoding can end:
``t`` ends prefix ``i`` if the token that ends prefix ``i - len(t)`` may stand before it, that is
if encoding the two tokens' bytes together gives the two tokens again. ``PrefixTable`` keeps that
last token for each prefix. So bytes can be appended without touching what is there, and after an
edit only the entries up to the point where the table agrees with the old one again are made anew.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct pieces in each of the two generations that a Python worker keeps, and token pairs.
CACHED_PIECES, CACHED_PAIRS = 120_000, 400_000
#: Texts of more characters than this are matched in parts.
LONG_TEXT = 1 << 20
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens, their ranks, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        #: Tokens from their last byte to their first; the key -1 holds the rank.
        self.endings: dict = {}
        for token, rank in ranks.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._lengths = np.array([*map(len, self.tokens)], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merge(self, data: bytes, down_to: int = 1) -> list[int]:
        """The definition itself: join the neighbours of lowest rank until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)), i) for i in range(len(parts) - 1))
            if rank == len(self.tokens):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose joining makes this one; None for a byte."""
        if token not in self._halves:
            data = self.tokens[token]
            self._halves[token] = None if len(data) == 1 else tuple(self.merge(data, 2))
        return self._halves[token]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after the other, gathered at once."""
        n = self._lengths[ids]
        first = np.cumsum(n)
        total = int(first[-1]) if len(n) else 0
        at = np.repeat(self._starts[ids] - (first - n), n)
        at += np.arange(total, dtype=np.int64)
        return self._bytes[at].tobytes()

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, encoded together, give the two tokens.

        Joins happen in the order of their ranks. Going back in that order, the pieces that touch
        the border are taken apart, the younger one first; if two of them that stood side by side
        could have been joined before either went into its own token, the border would be gone.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._border(left, right)
        return known

    def _border(self, a: int, b: int) -> bool:
        a_goes = b_goes = len(self.tokens)  # the ranks at which a and b go into what they are part of
        while True:
            join = self.ranks.get(self.tokens[a] + self.tokens[b])
            if join is not None and join < a_goes and join <= b_goes:
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and a > b):
                a, a_goes = of_a[1], a
            else:
                b, b_goes = of_b[0], b


class PrefixTable:
    """The encoding of a growing or edited byte string. last[i] ends the prefix of i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.append(data)

    def _entry(self, data: bytes, last: list[int], end: int) -> int:
        v = self.vocabulary
        node, start, found = v.endings, end, []
        while start:
            node = node.get(data[start - 1])
            if node is None:
                break
            start -= 1
            token = node.get(-1)
            if token is not None:
                found.append((start, token))
        pairs = v._pairs
        for start, token in reversed(found):  # most often the longest one
            if not start:
                return token
            ok = pairs.get(last[start] << 32 | token)
            if ok or ok is None and v.may_follow(last[start], token):
                return token
        raise ValueError(f"byte {data[end - 1]} is in no token")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        data, last, entry = self.data + more, self.last, self._entry
        for end in range(at + 1, len(data) + 1):
            last.append(entry(data, last, end))
        self.data = data

    def truncate(self, length: int) -> None:
        del self.last[length + 1 :]
        self.data = self.data[:length]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts new in place of data[start:stop]; returns how many entries were made anew."""
        data = self.data[:start] + new + self.data[stop:]
        last, moved = self.last[: start + 1], len(new) - (stop - start)
        same = 0
        for end in range(start + 1, len(data) + 1):
            last.append(self._entry(data, last, end))
            old = end - moved
            same = same + 1 if end > start + len(new) and last[end] == self.last[old] else 0
            if same >= self.vocabulary.longest:  # later entries look back no further than this
                last += self.last[old + 1 :]
                made = end - start
                break
        else:
            made = len(data) - start
        self.data, self.last = data, last
        return made

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers. When full it becomes the old
    generation, whose pieces are taken over again as they are asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}
        self._table = PrefixTable(vocabulary)

    def add(self, pieces) -> None:
        """Encodes those not known yet, in order, so that each starts from what it shares with the one before."""
        known = self.keys()
        for piece in sorted(pieces - known):
            if len(piece) <= 64:
                self[piece]

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            data, table = piece.encode("utf-8"), self._table
            rank = self.vocabulary.ranks.get(data)
            if rank is None:
                before, same = table.data, 0
                for x, y in zip(before, data):
                    if x != y:
                        break
                    same += 1
                table.truncate(same)
                table.append(data[same:])
                ids = table.ids()
            else:
                ids = (rank,)
            out = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Tokenizer:
    """Splits by the pattern, encodes each match by itself, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self._pieces = _Pieces(self.vocabulary)

    def packed(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, a long text in parts."""
        if len(text) <= LONG_TEXT:
            yield b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))
            return
        matches = self.pattern.finditer(text)
        while part := list(islice(matches, 1 << 16)):
            yield b"".join(self._pieces[m.group()] for m in part)

    def packed_all(self, texts: list[str]) -> Iterator[list[bytes]]:
        """packed() of each text, as a list; the new pieces of all the shorter texts are encoded together."""
        found = [self.pattern.findall(t) if len(t) <= LONG_TEXT else None for t in texts]
        self._pieces.add(set().union(*(x for x in found if x)))
        for text, pieces in zip(texts, found):
            yield list(self.packed(text)) if pieces is None else [b"".join(map(self._pieces.__getitem__, pieces))]

    def encode(self, text: str) -> list[int]:
        return [x for part in self.packed(text) for x in np.frombuffer(part, "<u4").tolist()]

    def decode(self, ids) -> bytes:
        return self.vocabulary.decode(np.asarray(ids, np.int64))


def _in_batches(batches, path: str, pattern: str, digest: bool):
    tok = tokenizer(path, pattern)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows = []
            for parts in tok.packed_all([t or "" for t in batch.column(1).to_pylist()]):
                if not digest:
                    rows.append(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                    continue
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in parts:
                    ids.update(part)
                    n += len(part) // 4
                    back.update(tok.decode(np.frombuffer(part, "<u4")))
                rows.append((n, ids.hexdigest(), back.hexdigest()))
            key = batch.column(0)
            if digest:
                n, a, b = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([key, pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])


_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each rank file and pattern in a Python worker, with what it has cached."""
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = Tokenizer(load_ranks(path), pattern)
    return _TOKENIZERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs.

    A null or empty text has no ids; a null doc_id stays null; rows that are there twice come out
    twice; other columns are ignored, whatever their names. Texts of any length are encoded whole.
    The rank file must be at ``path`` on every executor. No shuffle: one pass over the rows.
    """
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(lambda batches: _in_batches(batches, path, pattern, False), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digests of each text's ids and of the bytes that decoding them gives; nulls etc. as encode()."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(lambda batches: _in_batches(batches, path, pattern, True), SCHEMA)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids); null ids give empty bytes."""

    def run(batches):
        v = Vocabulary(load_ranks(path))
        for batch in batches:
            data = [v.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")
