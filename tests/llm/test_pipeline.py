"""All stages on the smallest tables, against the same steps by brute force."""

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from fringework.llm import bpe, decontam
from tests.llm.test_quality import brute as judged
from tests.llm.test_repeats import gone_of
from fringework.llm.common import shared_dir, stored
from tests.llm.test_jaccard import brute as first_of_each

DIR = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_run_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if r.quality == 1}
    kept = {r[0]: docs[r[0]] for r in judged(list(docs.items()), good) if r[7]}
    first = {i for _, i in first_of_each(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if i in first}
    data = [t.encode() for t in kept.values()]
    cut = {i: bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore") for i, d, gone in zip(kept, data, gone_of(data, corpus_pipeline.PASSAGE))}
    items = decontam.Items([(r.item_id, decontam.normal(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    left = {i: t for i, t in cut.items() if not items.find(decontam.normal(t))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in left.items():
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(want)


def test_passages_of_fifty_words_go(spark):
    """Every passage of over 50 words that two documents share, on a thousand documents, and next to nothing else."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, d)
    docs = stored(docs, shared_dir(spark), "docs")
    words = {r.doc_id: r.text.split() for r in docs.collect()}
    seen: dict[str, set] = {}
    for i, w in words.items():
        for k in range(len(w) - 50):
            seen.setdefault(" ".join(w[k : k + 51]), set()).add(i)
    planted = {p: ids for p, ids in seen.items() if len(ids) > 1}
    left = {r.doc_id: r.text.split() for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    still = {" ".join(w[k : k + 51]) for w in left.values() for k in range(len(w) - 50)}
    assert len(planted) > 100 and len(still & planted.keys()) <= 0.03 * len(planted)
    clean = [i for i in words if not any(i in ids for ids in planted.values())]
    assert sum(left[i] == words[i] for i in clean) >= 0.9 * len(clean)


def test_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "", "", 0), (10**6, "", "", "", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0
        assert stage(spark, odd, DIR).count() <= 6
    assert corpus_pipeline.repeated_passages(spark, odd, DIR).count() == 6 and corpus_pipeline.decontaminated(spark, odd.drop("n_chars"), DIR).count() == 6
    assert corpus_pipeline.repeated_passages(spark, odd.drop("n_chars"), DIR).columns == ["doc_id", "text", "lang", "source"]


def test_columns_stay(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, DIR)
        assert out.dtypes == docs.dtypes
    cut = corpus_pipeline.repeated_passages(spark, docs, DIR).collect()
    assert all(r.n_chars == len(r.text) for r in cut)
