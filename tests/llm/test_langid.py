import numpy as np
from pyspark.sql import functions as F

from fringework.llm import langid


def test_pieces_of_evidence():
    assert langid.declared('<!DOCTYPE html><HTML class="x" lang="De-AT">') == "de" and langid.declared(None) == "" and langid.declared("<p lang=fr>") == ""
    assert langid.host_levels("http://u@WWW.A.example.de:80/x") == ("www.a.example.de", "example.de", "de") and langid.host_levels(None) == ("", "", "") and langid.host_levels("http://h/") == ("h", "h", "")
    assert langid.visible("<p>a</p><script>b<c</script><!-- d -->e").split() == ["a", "e"]


def test_held_out_documents(spark):
    """Text alone, on documents that the models have not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, w = langid.fit(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1 and n_chars > 100").select("lang", "text").collect()
    right = sum(names[int((w @ langid.counts(r.text)).argmax())] == r.lang for r in rows)
    assert right >= 0.97 * len(rows)


def brute(rows, names, w):
    """The same fusion, on the driver."""
    order = sorted(range(len(names)), key=names.__getitem__)
    names, w, k = [names[i] for i in order], w[order], len(names)
    seen = []
    for p, u, h in rows:
        c = langid.counts(langid.visible(h))
        at = np.flatnonzero(c)
        ll = np.round((w[:, at].astype(float) @ c[at]) / max(1, c.sum()) * min(langid.TEXT_GRAMS, c.sum()) * 1e6)
        seen.append((p, *langid.host_levels(u), langid.declared(h), ll / 1e6, int(ll.argmax())))
    n = lambda f: np.bincount([s[6] for s in seen if f(s)], minlength=k)
    flat = (n(lambda s: True) + 1) / (len(seen) + k)
    K = langid.KAPPA
    up = lambda c, above: (c + K * above) / (c.sum() + K)
    out = []
    for p, host, domain, suffix, said, ll, guess in seen:
        own = np.eye(k, dtype=int)[guess]
        prior = up(n(lambda s: s[3] == suffix) - own, flat)
        prior = up(n(lambda s: (s[2], s[3]) == (domain, suffix)) - own, prior)
        prior = up(n(lambda s: (s[1], s[2]) == (host, domain)) - own, prior)
        by_said = np.log(up(n(lambda s: s[4] == said) - own, flat) / flat) if said else 0
        total = np.round(ll * langid.TEXT_WEIGHT + by_said + np.log(prior), 6)
        out.append((p, names[int(total.argmax())], said, suffix, host, round(float(1 / np.exp(total - total.max()).sum()), 6)))
    return out


def test_fusion_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    names, w = langid.fit(spark.read.parquet(f"{d}/documents.parquet"))
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").unionByName(
        spark.createDataFrame([(None, None, None), (9001, "", ""), (9002, "http://x.de/", "<html lang=de>"), (9002, "http://x.de/", "<html lang=de>"), (9003, "http://tionsh.example.net/1", "<p>" + "der die und " * 20000)], "page_id bigint, url string, html string")
    )
    pages = pages.withColumn("host", F.lit(1)).withColumn("lang", F.lit("zz"))
    got = sorted(map(tuple, langid.judge(pages, names, w).collect()), key=str)
    want = sorted(brute([(r.page_id, r.url, r.html) for r in pages.collect()], names, w), key=str)
    assert [g[:5] for g in got] == [x[:5] for x in want] and np.allclose([g[5] for g in got], [x[5] for x in want], atol=1e-4)
    html = {r.page_id: langid.declared(r.html) for r in pages.collect() if r.page_id is not None and r.page_id < 9000}
    assert np.mean([html[g[0]] == g[1] for g in got if g[0] in html]) >= 0.9
    assert langid.judge(pages.limit(0), names, w).count() == 0


def test_without_languages(spark):
    docs = spark.createDataFrame([(1, None, "x")], "doc_id bigint, lang string, text string")
    names, w = langid.fit(docs)
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id bigint, url string, html string")
    assert names == [] and langid.judge(pages, names, w).first().lang is None


def test_every_language_has_a_model(spark):
    """70 languages, and a rare one with a single document among thousands."""
    word = lambda i, j: chr(97 + i % 26) * 2 + chr(97 + i // 26) * 2 + chr(97 + j) * 2
    rows = [(i * 10 + c, f"l{i:02d}", " ".join(word(i, j) for j in range(10))) for i in range(70) for c in range(3)]
    rows += [(1000 + c, "l00", " ".join(word(0, j) for j in range(10))) for c in range(8000)]
    rows += [(20_000, "rare", "qoqoqo wuwuwu")]
    names, w = langid.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert len(names) == 71 and all(row.std() > 0 for row in w)
    pages = [(i, f"http://h{i}.x/", f"<p>{' '.join(word(i, j) for j in range(10))}") for i in range(70)] + [(99, "http://r.y/", "<p>qoqoqo wuwuwu")]
    got = {r.page_id: r.lang for r in langid.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), names, w).collect()}
    assert got == {i: f"l{i:02d}" for i in range(70)} | {99: "rare"}
