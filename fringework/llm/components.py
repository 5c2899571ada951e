"""Connected components of a link table, by alternating large and small stars, and the first row of each class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fringework.llm.common import drop_dir, stored

#: What names a row, null ids and rows that share an id included: whether the id is null, the id, the text's hash.
KEY = ["_null", "_id", "_hash"]


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    links: (a, b) bigint, in any order, repeated or looped or with nulls (those are left out).
    Each round is written to ``folder``, so that the plan stays short and a lost executor costs
    one round at most. Only a row count and a checksum of a round reach the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, folder, "links-0")
    mark = _mark(edges)
    for k in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), folder, f"links-{k}")
        drop_dir(edges.sparkSession, f"{folder}/links-{k - 1}")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    else:
        raise RuntimeError(f"links are not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with the columns of KEY."""
    i = docs[doc_id].cast("bigint")
    return docs.withColumns({"_null": i.isNull(), "_id": F.coalesce(i, F.lit(0)), "_hash": F.xxhash64(F.coalesce(docs[text], F.lit("")))})


def first_of_each(named: DataFrame, own: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """The rows of named (with KEY) that come first in their class: the smallest id, null ids last; of rows alike one.

    own(KEY, node) has the node of each row, roots(node, root) the class of each node that has a link.
    """
    spark, r = named.sparkSession, roots.select(F.col("node").alias("_node"), "root")
    best = own.groupBy("node").agg(F.min(F.struct(*KEY)).alias("best"))
    rooted = stored(best.join(r.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", "best", F.coalesce("root", "node").alias("root")), folder, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("best").alias("low"))
    kept = rooted.join(lowest.hint("merge"), "root").select("node", "low")
    gone = stored(own.select(*KEY, "node").join(kept.hint("merge"), "node").where(F.struct(*KEY) != F.col("low")).select(*KEY).distinct(), folder, "gone")
    drop_dir(spark, f"{folder}/rooted")
    left = named.join(gone.hint("merge"), KEY, "left_anti")  # one plan at every size
    return left.withColumn("_nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("_hash"))).where("_nth = 1")
