"""Versioned snapshots of a table and the row changes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("_change_type", "_commit_version", "_commit_timestamp")


def _stamped(df: DataFrame, kind: Column, version: int, at: Column) -> DataFrame:
    return df.withColumn("_change_type", kind).withColumn("_commit_version", F.lit(version).cast("long")).withColumn("_commit_timestamp", at)


def first_version(snapshot: DataFrame, at: Column, version: int = 0) -> DataFrame:
    """Every row as an insert."""
    return _stamped(snapshot, F.lit("insert"), version, at)


def changes(before: DataFrame, after: DataFrame, version: int, at: Column, key: tuple[str, ...] = ()) -> DataFrame:
    """The least change from before to after, repeats counted.

    Rows only in after are inserts, rows only in before deletes. With a key that identifies a row, a pair of both is update_preimage and update_postimage. Nulls equal nulls. One aggregation by the whole row replaces two set differences.
    """
    names = after.columns
    tagged = before.select(*names, F.lit(-1).alias("__side")).unionByName(after.select(*names, F.lit(1).alias("__side")))
    net = tagged.groupBy(*names).agg(F.sum("__side").alias("__net")).where("__net != 0")
    if key:
        sides = net.groupBy(*(F.col(k).alias(f"__key_{k}") for k in key)).agg(F.max(F.when(F.col("__net") < 0, 1).otherwise(0)).alias("__gone"), F.max(F.when(F.col("__net") > 0, 1).otherwise(0)).alias("__come"))
        on = F.lit(True)
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        net = net.join(sides.where("__gone + __come = 2"), on, "left").select(*names, "__net", F.col("__gone").isNotNull().alias("__paired"))
    else:
        net = net.withColumn("__paired", F.lit(False))
    come = F.col("__net") > 0
    kind = F.when(F.col("__paired"), F.when(come, "update_postimage").otherwise("update_preimage")).otherwise(F.when(come, "insert").otherwise("delete"))
    each = _stamped(net, kind, version, at).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__net"))))
    return each.select(*names, *META)


def overwrite_changes(before: DataFrame, after: DataFrame, version: int, at: Column) -> DataFrame:
    """What an overwrite of the whole table records: every old row as a delete, every new one as an insert."""
    return _stamped(before.select(*after.columns), F.lit("delete"), version, at).unionByName(_stamped(after, F.lit("insert"), version, at))


def feed_profile(feed: DataFrame) -> DataFrame:
    return feed.groupBy("_commit_version", "_change_type").agg(F.count(F.lit(1)).alias("n"))
