"""The session that the engine's tests, bench and command line use; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC because days and watermarks follow the session's zone; AQE for coalescing, skew and join choice at run time.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("sluice").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
