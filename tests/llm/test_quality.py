import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from fringework.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = W.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    cov = set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            cov |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cov), n < 50 or 100 * len(cov) > 50 * n


def h(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return (seed - (1 << 64) if seed >> 63 else seed) % quality.BUCKETS


def grams(text):
    w = W.findall(text or "")
    return [h(x) for x in w] + [h(x, y) for x, y in zip(w, w[1:])]


def brute(rows, good):
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = grams(t)
        raw.update(g)
        if i in good:
            target.update(g)
    share, c = sum(target.values()) / max(1, sum(raw.values())), quality.SMOOTHING
    weight = {b: round(math.log((target[b] + c) / (raw[b] * share + c)) * (1 << 20)) if share else 0 for b in raw}
    out = []
    for i, text in rows:
        g = grams(text)
        score = sum(weight[b] for b in g) / len(g) / (1 << 20) if g else 0.0
        *counts, failed = base(text)
        out.append((i, *counts, failed, not failed and score >= quality.THRESHOLD, score))
    return out


def check(got, want):
    key = lambda x: (str(x[0]), *x[1:7])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all(abs(g[8] - w[8]) < 1e-5 for g, w in zip(got, want))


def test_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows, good = [(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in labels.collect() if r.quality == 1}
    got = quality.judge(docs, labels)
    check(got.collect(), brute(rows, good))
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.collect() if r.kept}


def test_labelled_documents_apart(spark):
    """On documents whose labels it has not seen: what is marked as good stays, and most of the rest goes."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    share = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.9 and share[0] <= 0.4


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (None, "a b a b a b"), (5, "x\ny\nx\n\n \nx"), (5, "x\ny\nx\n\n \nx"), (6, "word " * 30000), (7, "é# ü$ \x85 x|y"), (8, " ".join(f"w{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, kept string, n_words int")
    labels = spark.createDataFrame([(8, 1), (None, 1), (8, 1), (5, None), (1, 0)], "doc_id bigint, quality int")
    check(quality.judge(docs, labels).collect(), brute(rows, {8}))
    check(quality.judge(docs, labels.limit(0)).collect(), brute(rows, set()))
    assert [r.doc_id for r in quality.keep(docs, labels).collect()] == [8]
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.keep(docs.limit(0), labels).count() == 0
