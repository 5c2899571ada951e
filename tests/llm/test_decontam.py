import random

import pytest

from fringework.llm import decontam as dc


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, data, k):
    data = bytearray(data)
    for _ in range(k):
        p = rng.randrange(len(data))
        kind = rng.randrange(3)
        if kind == 0:
            data[p] = rng.choice(b"abc ")
        elif kind == 1:
            del data[p]
        else:
            data.insert(p, rng.choice(b"abc "))
    return bytes(data)


@pytest.mark.parametrize("q,rate", [(4, 0.1), (6, 0.1), (12, 0.05)])
def test_found_as_by_brute_force(q, rate):
    rng = random.Random(q)
    new = lambda n: bytes(rng.choice(b"abcdefgh  ") for _ in range(n))
    items = [(k, new(rng.choice([30, 60, 90, 150]))) for k in range(8)]
    index = dc.Items(items, q, rate)
    for _ in range(60):
        k, item = rng.choice(items)
        text = new(rng.randrange(80)) + edited(rng, item, rng.randrange(12)) + new(rng.randrange(80))
        want = {(i, e) for i, t in items if (e := least_edits(t, text)) <= dc.budget(len(t), rate)}
        assert set(index.find(text)) == want


@pytest.mark.parametrize("window", [1, 40, 1 << 18])
def test_short_items_and_windows(monkeypatch, window):
    """Items from one byte on, in texts of many windows, with hits in small lots: as by brute force."""
    monkeypatch.setattr(dc, "WINDOW", window)
    monkeypatch.setattr(dc, "HELD", 50)
    rng = random.Random(window)
    new = lambda n: dc.normal("".join(rng.choice("aab ") for _ in range(n)))
    items = [(m, t) for m in (1, 2, 3, 5, 7, 8, 9, 15, 19, 20, 23, 24, 25, 40, 61) if (t := new(m))]
    index = dc.Items(items + items[:2])
    for _ in range(25):
        text = dc.normal(b"".join(rng.choice([new(rng.randrange(60)), edited(rng, t := rng.choice(items)[1], min(rng.randrange(3), len(t) - 1)), b" ", b"x"]) for _ in range(6)).decode())
        want = []
        for i, t in items + items[:2]:
            if len(t) < dc.SHORT:
                places = [a for a in range(len(text)) if text.startswith(t, a)]
                part = lambda a, b: text[a : a + 1].isalnum() and text[b : b + 1].isalnum()
                if any(not (a and part(a - 1, a)) and not part(a + len(t) - 1, a + len(t)) for a in places):
                    want.append((i, 0))
            elif (e := least_edits(t, text)) <= dc.budget(len(t)):
                want.append((i, e))
        assert sorted(index.find(text)) == sorted(want)


def test_very_long_text_of_one_gram():
    """Every gram of the text hits every gram of the item."""
    assert dc.Items([(1, b"a" * 300)]).find(b"a" * 20_000) == [(1, 0)] and dc.Items([(1, b"of peru")]).find(b"x" * 9 + b" of peru, " + b"y" * 9) == [(1, 0)]


def test_operator(spark, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog and then it sleeps for a very long time."
    bench = spark.createDataFrame([(1, item, "a"), (2, None, "b"), (3, "", "c"), (4, "Short", "d"), (5, item.upper(), "e")], "item_id bigint, text string, doc_id string")
    docs = spark.createDataFrame(
        [(10, f"x y {item} z", 1), (11, "nothing", 2), (12, None, 3), (13, "", 4), (None, item.replace("lazy", "lazi"), 5), (14, " SHORT ", 6), (15, "w " * 9000 + item.replace(" ", "\n\t"), 7), (15, item[:60], 8)],
        "doc_id bigint, text string, item_id int",
    )
    want = [(10, 1, 0), (10, 5, 0), (14, 4, 0), (15, 1, 0), (15, 5, 0), (None, 1, 1), (None, 5, 1)]
    for size in (1 << 20, 50):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        assert sorted(map(tuple, dc.leaks(docs, bench).collect()), key=str) == want
        kept = dc.clean(docs, bench)
        assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [2, 3, 4, 8]
    assert dc.leaks(docs.limit(0), bench).count() == 0 and dc.leaks(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == 8
