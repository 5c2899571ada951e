"""A training-data pipeline over ``documents``: the stages in order, and all of them at once."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fringework.llm import bpe, decontam, quality, simhash, suffix
from fringework.llm.common import shared_dir, stored, table
from fringework.llm.queries import RANKS

#: Bytes that a repeated passage has at least, and of the grams that anchor it. Fifty words of five bytes, space included,
#: fill it; op7_suffix has its contract's 400, which passages of fifty to sixty words don't.
PASSAGE, PASSAGE_GRAM = 250, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; rows alike share a verdict; an empty table stays empty."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest id stays, null ids last; null and blank texts are one class; an empty table stays empty.
    """
    return simhash.near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE bytes and more that are anywhere twice.

    n_chars follows the text, where there is such a column. A null text becomes empty; no row goes,
    even if nothing of its text is left. Of a passage that is there twice no occurrence stays.
    """
    cut = suffix.cut(docs, PASSAGE, PASSAGE_GRAM)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; null and empty items are nowhere."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to, a row for each row; a null text has no ids."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]

#: Fingerprints, hashed weights and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
