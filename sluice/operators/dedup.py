"""Deduplication of event streams under a watermark, its batch twin and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import percentage

DELAY = "2 days"


def dedup_stream(stream: DataFrame, keys: tuple[str, ...] = ("event_id",), time: str = "event_timestamp", delay: str = DELAY) -> DataFrame:
    """The first arrival of each key within the delay; rows older than the watermark are dropped. State is one key, evicted by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def dedup_batch(df: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One row of each key. Which of several stays is unspecified, as in a stream."""
    return df.dropDuplicates(list(keys))


def dedup_metrics(source: DataFrame, kept: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row: records before and after, how many went (repeats and late rows together) and their share in percent, 0.0 of none."""
    counts = source.agg(F.count(F.lit(1)).alias("source_records")).crossJoin(kept.agg(F.count(F.lit(1)).alias("deduplicated_records")))  # one row each
    gone = F.col("source_records") - F.col("deduplicated_records")
    return counts.select("source_records", "deduplicated_records", gone.alias("duplicates_removed"), F.coalesce(percentage(gone, F.col("source_records")), F.lit(0.0)).alias("duplicate_rate_pct"), F.lit(delay).alias("watermark_delay"))


def dedup_breakdown(source: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """What the metrics lump together: repeated rows, and keys that were dropped altogether as late."""
    distinct = source.select(*keys).distinct()
    late = distinct.join(kept.select(*keys).distinct(), list(keys), "left_anti").agg(F.count(F.lit(1)).alias("dropped_late"))
    repeats = source.agg(F.count(F.lit(1)).alias("n")).crossJoin(distinct.agg(F.count(F.lit(1)).alias("d"))).select((F.col("n") - F.col("d")).alias("repeats"))
    return repeats.crossJoin(late)  # one row each


def repeated_keys(df: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
