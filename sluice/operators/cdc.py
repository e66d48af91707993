"""Type 2 history of a dimension from change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The attributes of a version that consumers read, in their order.
ATTRIBUTES = ("customer_id", "customer_name", "segment", "service_zone_id", "email", "phone", "address_line1", "city", "state", "postal_code", "account_status")


def scd2(changes: DataFrame, key: str = "customer_id", order: tuple[str, ...] = ("sequence_num", "event_timestamp", "cdc_event_id"), time: str = "event_timestamp", operation: str = "operation", attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Every insert or update is a version, which ends at the key's next event of any kind; a delete only ends one.

    is_current says that nothing follows. closed_by_delete is null for current versions. One shuffle and one sort by key: both leads share a window. A key's whole history meets in one task, as its order demands.
    """
    window = Window.partitionBy(key).orderBy(*order)
    led = changes.withColumn("next_time", F.lead(time).over(window)).withColumn("next_operation", F.lead(operation).over(window))
    return led.where(F.col(operation) != "delete").select(
        *attributes, F.col(time).alias("effective_start_timestamp"), F.col("next_time").alias("effective_end_timestamp"), F.col("next_time").isNull().alias("is_current"), (F.col("next_operation") == "delete").alias("closed_by_delete"), "sequence_num", "cdc_event_id"
    )


def current(dimension: DataFrame) -> DataFrame:
    return dimension.where("is_current")


def current_violations(dimension: DataFrame, key: str = "customer_id") -> DataFrame:
    """Keys with more than one current version; there should be none."""
    return current(dimension).groupBy(key).agg(F.count(F.lit(1)).alias("current_versions")).where("current_versions > 1")


def operations_profile(changes: DataFrame, operation: str = "operation") -> DataFrame:
    return changes.groupBy(operation).agg(F.count(F.lit(1)).alias("n"))
