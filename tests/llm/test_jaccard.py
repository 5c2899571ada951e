import random
import re

import pytest

from fringework.llm import jaccard


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Sorted rows that stay: the least of each class by (no id, id)."""
    s, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or 9 * len(s[i] & s[j]) >= 4 * (len(s[i]) + len(s[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(least.values())


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


@pytest.mark.parametrize("long,last", [(64, 1 << 17), (3, 1 << 17), (3, 2)])
def test_near_copies_by_brute_force(spark, monkeypatch, long, last):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "LAST", last)
    rng = random.Random(long)
    base = [[rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(99)) for _ in range(n)] for n in (30, 60, 61, 200, 7)]
    rows = []
    for i in range(150):
        w = list(base[i % 5])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        rows.append((i, " ".join((["one", "line", "that", "all", "texts", "have"] if i % 2 else []) + w)))
    want = brute(rows)
    assert 5 < len(want) < 140
    assert ids(jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))) == want


def test_stage_removes_what_differs_in_more_than_two_bits(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(corpus_pipeline.near_duplicates(spark, docs, "")) == brute(rows)


def test_rows_alike(spark):
    a, b = "a b c d e f g", "some other text of more words"
    rows = [(3, a), (7, a), (7, b), (9, a.upper()), (9, b), (9, b), (None, a), (None, "zz"), (None, "ZZ"), (4, None), (5, " \t")]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(out.collect(), key=str) == sorted([(3, a), (7, b), (4, None), next(r for r in map(tuple, out.collect()) if r[0] is None)], key=str)
    assert jaccard.keep_one(out.limit(0)).count() == 0


def test_pairs_do_not_grow_with_the_square_of_a_list(spark, monkeypatch):
    """Texts that have most of a passage, too little for a link: few of their pairs are verified, and no link is lost."""
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(99)) for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        w = list(base)
        for at in rng.sample(range(0, 150, 6), 2 + i % 5):
            w[at] = str(10**6 + rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    asked, real = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
    assert ids(jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)
    assert sum(asked) <= jaccard.LONG // 2 * len(rows)  # what short lists may give
