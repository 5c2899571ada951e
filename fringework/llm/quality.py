"""Quality rules: word and line counts, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Each word and each pair of neighbouring words falls into one of ``BUCKETS`` hash buckets. A bucket's
weight is the logarithm of its count in the trusted documents over the count that its share of the
whole corpus lets expect there, both with ``SMOOTHING`` added, so that rare buckets weigh little. It
is a whole number of 2^-20, so that sums don't depend on their order. A document's score is the mean
weight of its n-grams, worked out inside its own row: weights go out as one array in the plan, and a
verdict needs neither a row number nor a shuffle. Every document is judged against the same threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fringework.llm.common import SPACE, drop_dir, shared_dir, stored

BUCKETS = 1 << 15
#: Ids of trusted documents are broadcast up to so many (8 bytes each), else joined by a shuffle; the counts are the same.
BROADCAST_IDS = 1_000_000
#: Mean weight, in nats an n-gram, below which a document is rejected: trusted text makes its n-grams at least 11 % less
#: likely than the corpus does. Chosen in round 1 by looking at labelled documents of 0.1 GB and of a thousand documents of
#: one generator, so for another corpus choose it anew; judge() and keep() take it as a parameter.
THRESHOLD = -0.12
SMOOTHING = 5.0
UNIT = float(1 << 20)
_WHITE = " \t\n\x0b\x0c\r"
_COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[^#*$%&|<>]+"


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def with_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _words, _row) for each row of docs; _row is the row itself."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    d = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), t.alias("_t"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    d = d.withColumns({"_words": words(F.col("_t")), "_lines": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.select(
        "doc_id", "_words", "_row",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )
    # inside a document a window is known by one hash of 64 bits over its three words
    threes = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("b"), F.slice("_words", 3, F.greatest(F.size("_words"), F.lit(1))).alias("c"))
    windows = F.slice(threes, 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    d = d.withColumn("_h", F.transform(windows, lambda w: F.xxhash64(w["a"], w["b"], w["c"])))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, j: F.col("_sorted")[k]["h"] == F.col("_sorted")[j]["h"]
    last = F.size("_sorted") - 1
    twice = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < last, same(k, k + 1)).otherwise(False))
    d = d.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.col("_sorted")[k]["i"]))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_at", zero, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "_words", "_row")


def _bucket(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")


def weights(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[int]:
    """The weight of each bucket, in units of 2^-20; zero for one that does not occur, and for all without trusted text.

    Trusted are all documents that labels(doc_id, quality) marks with quality 1; the corpus side counts all
    documents. BUCKETS rows reach the driver at most.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("_id")).where("_id is not null").distinct().withColumn("_in", F.lit(1))
    d = docs.select(docs[doc_id].cast("bigint").alias("_id"), docs[text].cast("string").alias("_t"))
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    d = d.join(F.broadcast(trusted) if few else trusted.hint("merge"), "_id", "left").select(words(F.col("_t")).alias("_words"), F.coalesce("_in", F.lit(0)).alias("_in"))
    nxt = F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1)))
    n = d.select("_in", F.inline_outer(F.arrays_zip(F.col("_words").alias("_a"), nxt.alias("_b"))).alias("_a", "_b"))
    n = n.select("_in", F.explode(F.array(F.when(F.col("_a").isNotNull(), _bucket("_a")), F.when(F.col("_b").isNotNull(), _bucket("_a", "_b")))).alias("bucket"))
    n = n.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_in").alias("target"))
    folder = shared_dir(docs.sparkSession)
    n = stored(n, folder, "counts")
    total = n.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    out = [0] * BUCKETS
    if total.target:
        weight = F.log((F.col("target") + SMOOTHING) / (F.col("raw") * F.lit(float(total.target) / float(total.raw)) + SMOOTHING))
        for r in n.select("bucket", F.round(weight * UNIT).cast("bigint").alias("weight")).collect():
            out[r.bucket] = r.weight
    drop_dir(docs.sparkSession, folder)
    return out


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, text: str, doc_id: str) -> DataFrame:
    """The counts of each row with base_failed, kept and score; the row itself as _row."""
    w = F.split(F.lit(",".join(map(str, weights(docs, labels, text, doc_id)))), ",").cast("array<bigint>")  # folded to one literal
    d = with_counts(docs, text, doc_id)
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("string").alias("last"))
    step = lambda s, x: F.struct((s["sum"] + F.get(w, _bucket(x)) + F.when(s["last"].isNull(), F.lit(0)).otherwise(F.get(w, _bucket(s["last"], x)))).alias("sum"), x.alias("last"))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    d = d.withColumn("score", F.when(n > 0, F.aggregate("_words", zero, step, lambda s: s["sum"]) / n / F.lit(UNIT)).otherwise(0.0))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # as a row of a generator: a filter on a result would else be pushed into the counts' own expressions, which would be worked out again for each word
    return d.select(F.inline_outer(F.array(F.struct(*_COUNTS, "base_failed", "kept", "score", "_row"))))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for each row of docs.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, and a score of ``threshold`` or more. Null and blank texts have no words, so they
    fail. Repeated rows and null ids are judged like any other; other columns are ignored. Without
    trusted documents all weights are zero and the base rules decide. Empty table: empty result.
    """
    return _judged(docs, labels, threshold, text, doc_id).select(*_COUNTS, "base_failed", "kept", "score")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. One pass over docs once the weights are known."""
    return _judged(docs, labels, threshold, text, doc_id).where("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
