"""A Spark session with the settings that the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "fringework", **conf: str) -> SparkSession:
    """Settings that are given win; the rest leaves partition sizes to adaptive execution."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (own | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
