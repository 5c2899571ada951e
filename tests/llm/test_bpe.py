import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings, strategies as st

from fringework.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOK = bpe.Tokenizer(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    assert TOK.encode(text) == REFERENCE.encode_ordinary(text)
    assert TOK.decode(TOK.encode(text)) == text.encode()


def test_every_code_point():
    for lo in [*range(0, 0x10000, 4096), *range(0x10000, 0x110000, 65536)]:
        text = "".join(f"a{chr(c)}b {chr(c)} " for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000)
        if text:
            assert TOK.encode(text) == REFERENCE.encode_ordinary(text), hex(lo)


def test_long_pieces():
    for text in ("a" * 5000, " " * 3000 + "x", "ab" * 2000, "=" * 4000, "é" * 1000):
        assert TOK.encode(text) == REFERENCE.encode_ordinary(text)


def test_text_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    text = "It's a long text  with 123 numbers\n\n and more." * 50
    assert TOK.encode(text) == REFERENCE.encode_ordinary(text)


def test_which_token_may_follow():
    rng = random.Random(5)
    v = TOK.vocabulary
    some = [*range(256), *(v.ranks[t] for t in v.tokens if set(t) <= set(b"aeinst ")), *rng.choices(range(50256), k=2000)]
    for _ in range(20000):
        a, b = rng.choice(some), rng.choice(some)
        assert v.may_follow(a, b) == (v.merge(v.tokens[a] + v.tokens[b]) == [a, b]), (v.tokens[a], v.tokens[b])


def test_append_and_replace():
    rng = random.Random(3)
    words = ["the", "tion", "in", " ", "a", "xq", "ing", "er"]
    for _ in range(150):
        data = "".join(rng.choices(words, k=40)).encode()
        t = bpe.PrefixTable(TOK.vocabulary, data)
        t.append(b"ation")
        data += b"ation"
        for _ in range(3):
            i = rng.randrange(len(data))
            j = min(len(data), i + rng.randrange(6))
            new = rng.choice(words).encode()
            t.replace(i, j, new)
            data = data[:i] + new + data[j:]
            fresh = bpe.PrefixTable(TOK.vocabulary, data)
            assert t.data == data and t.last == fresh.last and t.ids() == TOK.vocabulary.merge(data)
    t = bpe.PrefixTable(TOK.vocabulary, b"the cat sat on the mat " * 200)
    assert t.replace(5, 6, b"o") < 1000


def test_operator(spark):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (None, "né", "x"), (4, "word " * 60000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = REFERENCE.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    data = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert sorted(bytes(r.data) for r in data) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
