"""Array-shaped inputs derived from relational tables, the same way in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ANT, POL, CHAN, BEAM = 8, 2, 4, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, chan, ant, pol, byte): one packed sample for each event."""
    return packed(table(spark, sf_dir, "events"))


def packed(events: DataFrame) -> DataFrame:
    """An event is one sample; a table or a stream."""
    s = F.col("event_id")
    return events.select(
        F.expr("event_id div 64").alias("t"), F.expr("cast((event_id div 16) % 4 as int)").alias("chan"), (s % ANT).cast("int").alias("ant"),
        F.expr("cast((event_id div 8) % 2 as int)").alias("pol"), (F.floor(F.col("value") * 100).cast("bigint") % 256).alias("byte"),
    )


def filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(beam, chan, t, x): 64 samples of up to 16 channels for each beam; the last beam has as many channels as vectors are left."""
    return channels(table(spark, sf_dir, "embeddings"))


def channels(embeddings: DataFrame) -> DataFrame:
    """A vector is one channel of one beam; a table or a stream."""
    rows = embeddings.select(F.expr("vec_id div 16").alias("beam"), (F.col("vec_id") % 16).cast("int").alias("chan"), F.posexplode("embedding").alias("t", "e"))
    return rows.select("beam", "chan", F.col("t").cast("bigint").alias("t"), F.rint(F.col("e").cast("double") * 1000).cast("bigint").alias("x"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(b, i, k, re, im): complex 8 x 8 matrices of small whole numbers, one for each vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b"), F.posexplode("embedding").alias("p", "e"))
    x = F.rint(F.col("e").cast("double") * 100).cast("bigint")
    return e.select("b", F.expr("p div 8").cast("int").alias("i"), (F.col("p") % 8).cast("int").alias("k"), x.alias("re"), ((F.col("p") * 5 + F.col("b")) % 11 - 5).cast("bigint").alias("im"))


def weights(spark: SparkSession) -> DataFrame:
    """(chan, beam, ant, wre, wim): whole numbers."""
    w = spark.range(CHAN * BEAM * ANT).select(F.expr("cast(id div 64 as int)").alias("chan"), F.expr("cast((id div 8) % 8 as int)").alias("beam"), F.expr("cast(id % 8 as int)").alias("ant"))
    b, a, c = F.col("beam"), F.col("ant"), F.col("chan")
    return w.select("chan", "beam", "ant", ((b * 7 + a * 3 + c) % 15 - 7).alias("wre"), ((b * 5 + a * 11 + c * 2) % 15 - 7).alias("wim"))


def flags(spark: SparkSession) -> DataFrame:
    """(ant): antennas that are left out."""
    return spark.range(ANT).where("id % 5 = 3").select(F.col("id").cast("int").alias("ant"))


def geometry(spark: SparkSession) -> DataFrame:
    """(ant, e, n): places in metres."""
    a = F.col("id")
    return spark.range(ANT).select(a.cast("int").alias("ant"), (a * 13.5 - (a % 3) * 4.25).alias("e"), (a * 7.75 + (a % 4) * 2.5).alias("n"))


def calibration(spark: SparkSession) -> DataFrame:
    """(ant, fq, pol, re, im)."""
    c = spark.range(ANT * CHAN * POL).select(F.expr("cast(id div 8 as int)").alias("ant"), F.expr("cast((id div 2) % 4 as int)").alias("fq"), F.expr("cast(id % 2 as int)").alias("pol"), "id")
    return c.select("ant", "fq", "pol", ((F.col("id") * 7) % 9 - 4).cast("double").alias("re"), ((F.col("id") * 5) % 7 - 3).cast("double").alias("im"))


def baselines(spark: SparkSession) -> DataFrame:
    """(ant_i, ant_j, u_m, v_m) with ant_j <= ant_i, from the geometry. As many rows as the array has pairs."""
    pair = spark.range(ANT * ANT).select(F.expr(f"cast(id div {ANT} as int)").alias("ant_i"), F.expr(f"cast(id % {ANT} as int)").alias("ant_j")).where("ant_j <= ant_i")
    at = lambda k: geometry(spark).select(F.col("ant").alias(f"ant_{k}"), F.col("e").alias(f"e_{k}"), F.col("n").alias(f"n_{k}"))
    rows = pair.join(at("i"), "ant_i").join(at("j"), "ant_j")
    return rows.select("ant_i", "ant_j", (F.col("e_i") - F.col("e_j")).alias("u_m"), (F.col("n_i") - F.col("n_j")).alias("v_m"))


def pixels(spark: SparkSession, n: int = 64) -> DataFrame:
    """(beam, row, col); the last one lies outside the image."""
    b = F.col("id")
    return spark.range(8).select(b.cast("int").alias("beam"), F.when(b == 7, n).otherwise((b * 9) % n).cast("int").alias("row"), ((b * b * 5 + 3) % n).cast("int").alias("col"))
