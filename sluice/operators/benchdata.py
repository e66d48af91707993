"""Synthesis of a large table from a small one, for layout benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import salted_digest

ROWS, DAYS, PAYLOADS = 1_000_000, 365, 8


def replicate(df: DataFrame, rows: int = ROWS, key: str = "event_id", time: str = "event_timestamp") -> DataFrame:
    """Exactly rows rows (none of an empty df): as many whole copies of df as fit and some of its rows once more, each with its replica_id, a key made unique by it and a time moved by replica_id % DAYS days.

    Copies come from exploding a sequence in each row: no join and no shuffle. Only the rest, fewer rows than df has, goes through a limit.
    """
    n = df.count()
    copies, rest = divmod(rows, n) if n else (0, 0)
    each = df.withColumn("replica_id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)) if copies else F.array().cast("array<int>")))
    if rest:
        each = each.unionByName(df.limit(rest).withColumn("replica_id", F.lit(copies)))
    return each.withColumn(key, F.concat(F.col(key), F.lit("_r"), F.col("replica_id").cast("string"))).withColumn(time, F.timestamp_add("DAY", F.col("replica_id") % DAYS, F.col(time)))


def with_payloads(df: DataFrame, key: str = "event_id", payloads: int = PAYLOADS) -> DataFrame:
    """Two columns of digests that don't compress, so the table has a realistic size."""
    text = lambda side: F.concat(*(salted_digest(f"{side}{k}", F.col(key)) for k in range(payloads)))
    return df.withColumn("payload_a", text("a")).withColumn("payload_b", text("b"))
