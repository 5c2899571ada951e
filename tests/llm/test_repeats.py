import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fringework.llm import spans, suffix, superkmer


def gone_of(seqs, w):
    """Brute force: which units lie in a window whose content starts at two places or more."""
    count = Counter(tuple(s[i : i + w]) for s in seqs for i in range(len(s) - w + 1))
    out = []
    for s in seqs:
        g = [False] * len(s)
        for i in range(len(s) - w + 1):
            if count[tuple(s[i : i + w])] > 1:
                g[i : i + w] = [True] * w
        out.append(g)
    return out


def want_bytes(rows, w):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, g in zip(rows, texts, gone_of(texts, w)):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((i, len(t), sum(g), sum(x and (not k or not g[k - 1]) for k, x in enumerate(g)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def want_words(rows, w):
    texts = [(t or "").encode().split() for _, t in rows]
    return sorted(((i, len(t), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(t, g) if not y)).hexdigest()) for (i, _), t, g in zip(rows, texts, gone_of(texts, w))), key=str)


def made_up(seed, unit):
    """Texts with passages in common, runs, copies, nulls and empty ones."""
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice(unit) for _ in range(n))
    shared = [new(60) for _ in range(5)]
    rows = [(None, None), (1, ""), (2, unit[0] * 90), (2, unit[0] * 90), (3, (unit[0] + unit[1]) * 40)]
    for i in range(4, 60):
        parts = [new(rng.randrange(40)) if rng.random() < 0.5 else rng.choice(shared)[rng.randrange(20) :] for _ in range(4)]
        rows.append((i, "".join(parts)))
    return rows + rows[-4:] + [(100, rows[10][1][3:] + unit[2])]


@pytest.mark.parametrize("hot,width,q", [(1000, 24, 8), (1, 20, 5), (3, 24, 8)])
def test_bytes(spark, monkeypatch, hot, width, q):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "CHUNK", 64)
    monkeypatch.setattr(suffix, "BATCH", 7)
    rows = made_up(hot + width, "abécd\n ")
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, row int, keep string")
    assert sorted(map(tuple, suffix.digests(docs, width, q).collect()), key=str) == want_bytes(rows, width)


@pytest.mark.parametrize("hot", [1000, 1])
def test_words(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(superkmer, "BATCH", 7)
    rows = made_up(hot, ["a ", "be\t", "é ", "a\x85  ", "A\n", "zz  "])
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, packed string")
    assert sorted(map(tuple, superkmer.digests(docs, 10, 3).collect()), key=str) == want_words(rows, 10)


def test_whole_widths_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, suffix.digests(docs).collect()), key=str) == want_bytes(rows, 400)
    assert sorted(map(tuple, superkmer.digests(docs).collect()), key=str) == want_words(rows, 35)


def test_cut_and_empty(spark):
    t = "é" * 30
    docs = spark.createDataFrame([(1, "x" + t + "1", "en"), (2, None, "de"), (3, "yy" + t, "fr")], "doc_id bigint, text string, row string")
    got = {r.doc_id: r for r in suffix.cut(docs, 24, 8).collect()}
    assert suffix.cut(docs, 24, 8).columns == docs.columns
    assert got[1].text == "x1" and got[2].text == "" and got[3].text == "yy" and got[3].row == "fr"
    assert suffix.digests(docs.limit(0)).count() == 0 and superkmer.digests(docs.limit(0)).count() == 0


def test_gram_hashes_depend_on_content_only():
    u = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    for q in (1, 2, 3, 7, 8, 13, 64):
        h = spans.gram_hashes(u, q)
        assert len(h) == 300 - q + 1
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(tuple(u[i : i + q]), h[i]) == h[i]
        assert len(set(h.tolist())) == len(seen)
