"""Physical layout: scattering, clustering, compaction and what they leave on disk."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, FILE_BYTES = 32, 32 << 20
CLUSTER = ("service_zone_id", "event_timestamp")


def scatter_bucket(key: str = "event_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def scatter(df: DataFrame, key: str = "event_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows dealt out by a hash of key: the worst layout for range filters, as a baseline."""
    return df.withColumn("__bucket", scatter_bucket(key, buckets)).repartition(buckets, "__bucket").drop("__bucket")


def cluster(df: DataFrame, by: tuple[str, ...] = CLUSTER, files: int = BUCKETS) -> DataFrame:
    """Rows in ranges of by, sorted within, so footers' least and greatest values let scans skip files and row groups. Sampled splitters even out skew over all of by."""
    return df.repartitionByRange(files, *by).sortWithinPartitions(*by)


def files_for(size: int, target: int = FILE_BYTES) -> int:
    return max(1, ceil(size / target))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and the mean file size of a table's folder, from the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    sizes = []
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            sizes.append(status.getLen())
    n, total = len(sizes), sum(sizes)
    return spark.createDataFrame([(n, total, total / n if n else 0.0)], "num_files long, size_in_bytes long, mean_file_bytes double")


def optimize(spark: SparkSession, path: str, to: str, by: tuple[str, ...] = CLUSTER, target: int = FILE_BYTES) -> DataFrame:
    """Rewrites the table at path to another folder, clustered, in files of about target bytes; returns what describe says of it."""
    size = describe(spark, path).first()["size_in_bytes"]
    cluster(spark.read.parquet(path), by, files_for(size, target)).write.mode("overwrite").parquet(to)
    return describe(spark, to)


def empty_clone(df: DataFrame) -> DataFrame:
    """df's columns and no rows; the plan reads nothing."""
    return df.where(F.lit(False))
