import random
import re

import pytest
import xxhash

from fringework.llm import simhash
from fringework.llm.components import components


def plain(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps: dict[int, int], bits):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in ("", None, "A", "Äb C", "one two", "one two\tthree", "a b c a b c a b c", "É\x0b\x85x \x1cy z w"):
        assert simhash.fingerprint(t) == plain(t)


@pytest.mark.parametrize("bits,small", [(0, 64), (1, 3), (2, 64), (2, 3), (3, 3)])
def test_links_equal_brute_force(spark, tmp_path, monkeypatch, bits, small):
    if bits == 3 and small == 3:
        n = 12
    else:
        n = 120
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {i: base[i % 4] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for i in range(n)}
    fps = {i: f for i, f in enumerate(sorted(set(fps.values())))}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps.values()}
    nodes = spark.createDataFrame([(signed[f],) for f in fps.values()], "fp bigint")
    got = components(simhash.links(nodes, f"file://{tmp_path}/a", bits), f"file://{tmp_path}/b").collect()
    label = {f: f for f in signed.values()} | {r.node: r.root for r in got}
    want = brute(fps, bits)
    pairs = {(want[i], label[signed[f]]) for i, f in fps.items()}
    assert len(pairs) == len(set(want.values())) == len(set(label.values()))


def test_operator_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_001, None), (10_002, " \t"), (10_003, "x"), (10_004, "X")]
    fps = {i: plain(t) for i, t in rows}
    want = sorted((i, f"{fps[i]:016x}", c) for i, c in brute(fps, 2).items())
    clash = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id bigint, text string, fp int, component_id string")
    assert sorted(map(tuple, simhash.classes(clash).collect())) == want
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "A B C D"), (None, "zzz")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    assert got == sorted([(None, 2), (3, 2), (3, 2), (2, 2), (None, None)], key=str)
    assert simhash.classes(docs.limit(0)).count() == 0
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == [(2, "A B C D"), (None, "zzz")]
    same = spark.createDataFrame([(3, "a b c"), (7, "a b c"), (7, "z y x w v u t"), (9, "z y x w v u t"), (9, "z y x w v u t"), (None, "z y x w v u t")], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.keep_one(same).collect())) == [(3, "a b c"), (7, "z y x w v u t")]


def test_long_chain(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 2), (7, 6)], "a bigint, b bigint")
    got = components(links, f"file://{tmp_path}/c").collect()
    assert {r.node for r in got} == set(range(301)) and {r.root for r in got} == {0}


def test_near_copies_come_from_variants(spark, monkeypatch):
    """The stage's classes rest on fingerprints: what shares a variant is linked before the exact search, which has the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    rows += [(10_000 + i, t + " two more words") for i, t in rows if len((t or "").split()) > 60]
    asked, real = [], simhash.jaccard._verified

    def seen(pairs, best, texts, folder, name):
        out = real(pairs, best, texts, folder, name)
        asked.append((name, out.count()))
        return out

    monkeypatch.setattr(simhash.jaccard, "_verified", seen)
    kept = simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert max(r.doc_id for r in kept.collect()) < 10_000
    assert asked[0][0] == "alike" and asked[0][1] >= 0.6 * (len(rows) - 60) > 5


def test_variant_pairs_by_brute_force(spark):
    """Every set in a bucket of two is paired; a bucket of any size gives two pairs for each row at most."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [base[i % 40] ^ sum(1 << b for b in rng.sample(range(64), i // 40)) for i in range(120)] + [base[0]] * 50
    sets = [(i, 100 - i % 3, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {(r.a, r.b) for r in simhash.variant_pairs(spark.createDataFrame(sets, "node bigint, n int, fp bigint")).collect()}
    half = lambda i, j: min(((fps[i] ^ fps[j]) >> s & (1 << 32) - 1).bit_count() for s in (0, 32))
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if half(i, j) <= 1}
    assert got <= near and len(got) <= 2 * 64 * len(fps)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in near)
