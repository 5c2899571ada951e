"""Language of web pages by Bayesian fusion of four kinds of evidence.

The text's likelihood under hashed n-gram models, the language that the markup declares, the
address's suffix, and a prior of its host. A declaration counts by how often it goes with the text's
language. The suffix enters once, as a level of the prior: a host's prior is the share of languages
on its other pages, smoothed by that of its domain, which is smoothed by that of its suffix, which is
smoothed by all pages'; all by grouped counts, from which a page's own guess is taken out again.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fringework.llm.common import shared_dir, stored
from fringework.llm.urlfilter import parts

BUCKETS = 1 << 15
#: Different words of a task that are counted before their n-grams are.
WORDS_HELD = 1 << 18
#: How many other pages a level must have to weigh as much as the level above: fewer say little about a host.
KAPPA = 20.0
#: A text's n-grams overlap and repeat, so that they are not evidence as of their number: the mean of a text counts as that of
#: at most TEXT_GRAMS n-grams, each worth TEXT_WEIGHT of an independent one (an n-gram shares its bytes with four others).
TEXT_GRAMS, TEXT_WEIGHT = 100, 0.2
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.IGNORECASE | re.DOTALL)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)


def visible(html: str | None) -> str:
    return _TAGS.sub(" ", html or "")


def declared(html: str | None) -> str:
    m = _LANG.search(html or "")
    return m[1].lower() if m else ""


def host_levels(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix), each empty if there is none."""
    host = parts(url)[0].rpartition("@")[2].partition(":")[0].strip(".")
    names = host.split(".")
    return host, ".".join(names[-2:]), names[-1] if len(names) > 1 else ""


def counts(text: str | None) -> np.ndarray:
    """How often each bucket occurs: words, and trigrams of their letters."""
    total = np.zeros(BUCKETS, np.int64)
    _add(Counter((text or "").lower().encode("utf-8").split()), total)
    return total


def _add(words: Counter, total: np.ndarray) -> None:
    """Adds the buckets of counted words to total."""
    for word, n in words.items():
        total[xxhash.xxh64_intdigest(word) % BUCKETS] += n
        edge = b"^" + word + b"$"
        for i in range(len(edge) - 2):
            total[xxhash.xxh64_intdigest(edge[i : i + 3], 1) % BUCKETS] += n


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket for each); from all labelled documents, in all their languages.

    The driver and each worker hold 128 kB for a language, however many documents there are.
    """
    d = docs.select(docs[lang].alias("lang"), docs[text].alias("text")).where("lang is not null and lang <> ''")
    names = [r.lang for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]

    def summed(words: dict[str, Counter]):
        for name, w in words.items():
            n = np.zeros(BUCKETS, np.int64)
            _add(w, n)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    def run(batches):
        words: dict[str, Counter] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words.setdefault(name, Counter()).update((t or "").lower().encode("utf-8").split())
                if sum(map(len, words.values())) > WORDS_HELD:
                    yield from summed(words)
                    words = {}
        yield from summed(words)

    w, seen = np.zeros((len(names), BUCKETS), np.float32), {name: i for i, name in enumerate(names)}
    for r in d.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        w[seen[r.lang], r.bucket] = r.n  # a row for each language and bucket at most
    for i in range(len(names)):
        n = w[i].astype(np.float64) + 0.5
        w[i] = np.log(n / n.sum())
    return names, w


def judge(pages: DataFrame, names: list[str], weights: np.ndarray, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, lang, declared, suffix, host, share) for each row of pages; share is lang's part of the posterior.

    Null or empty html has no text and declares nothing, so the other evidence decides; without any
    the commonest language wins. Ties go to the language that comes first by name. Repeated rows and null
    ids come out as they are; other columns are ignored. Without languages lang and share are null.
    """
    folder, spark = shared_dir(pages.sparkSession), pages.sparkSession
    order = sorted(range(len(names)), key=names.__getitem__)
    names, sent = [names[k] for k in order], spark.sparkContext.broadcast(weights[order])

    def run(batches):
        w = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch, out = whole.slice(at, 200), []
                for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    c = counts(visible(h))
                    k = np.flatnonzero(c)
                    ll = (w[:, k].astype(np.float64) @ c[k]) / max(1, c.sum()) * min(TEXT_GRAMS, c.sum())
                    out.append((*host_levels(u), declared(h), np.round(ll * 1e6).astype(np.int64).tolist()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.int64()))], ["page_id", "host", "domain", "suffix", "declared", "ll"])

    rows = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    d = stored(rows.mapInArrow(run, "page_id bigint, host string, domain string, suffix string, declared string, ll array<bigint>"), folder, "text")
    if not names:
        return d.select("page_id", F.lit(None).cast("string").alias("lang"), "declared", "suffix", "host", F.lit(None).cast("double").alias("share"))
    k = len(names)
    d = d.withColumn("guess", F.array_position("ll", F.array_max("ll")).cast("int") - 1)

    def level(*by):
        """For each value of by how many pages are guessed to be in each language (every), and how many in all (n)."""
        n = d.groupBy(*by, "guess").agg(F.count("*").alias("n"))
        n = n.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"), F.sum("n").alias("n"))
        return n.select(*by, "n", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("every"))

    top = {r.guess: r["count"] for r in d.groupBy("guess").count().collect()}  # a row for each language at most
    flat = F.array(*[F.lit((top.get(i, 0) + 1.0) / (sum(top.values()) + k)) for i in range(k)])
    said = stored(level("declared").select("declared", F.struct("n", "every").alias("said")), folder, "said")
    suffix = stored(level("suffix").select("suffix", F.struct("n", "every").alias("in_suffix")), folder, "suffix")
    domain = stored(level("suffix", "domain").join(suffix, "suffix").select("domain", "in_suffix", F.struct("n", "every").alias("in_domain")), folder, "domain")
    host = level("domain", "host").join(domain, "domain")
    host = stored(host.select("host", "in_suffix", "in_domain", F.struct("n", "every").alias("in_host")), folder, "host")
    d = d.join(said, "declared").join(host, "host")

    def others(counts: str, above):
        """What the other pages of a level say, smoothed by the level above: the page's own guess doesn't count."""
        c = F.col(counts)
        return F.zip_with(F.transform(c["every"], lambda x, i: x - (i == F.col("guess")).cast("int")), above, lambda x, p: (x + KAPPA * p) / (c["n"] - 1 + KAPPA))

    d = d.withColumn("prior", others("in_suffix", flat)).withColumn("prior", others("in_domain", F.col("prior"))).withColumn("prior", others("in_host", F.col("prior")))
    # how often a declaration goes with a language, against how often the language is there at all
    lift = F.when(F.col("declared") != "", F.zip_with(others("said", flat), flat, lambda x, p: F.log(x / p))).otherwise(F.array_repeat(F.lit(0.0), k))
    d = d.withColumn("by_said", lift)
    total = F.zip_with(F.zip_with("ll", "by_said", lambda x, s: x / 1e6 * TEXT_WEIGHT + s), "prior", lambda x, p: F.round(x + F.log(p), 6))
    d = d.withColumn("total", total).withColumn("best", F.array_max("total"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    lang = F.element_at(F.array(*map(F.lit, names)), F.array_position("total", F.col("best")).cast("int"))
    return d.select("page_id", lang.alias("lang"), "declared", "suffix", "host", F.round(share, 6).alias("share"))
