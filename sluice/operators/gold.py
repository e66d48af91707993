"""The published aggregates, as functions of tables. Names of their columns are fixed values: consumers read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import count_if, exact_average, exact_total, percentage, sum_if

#: Thresholds of the leak heuristic and minutes to resolve by severity.
LOW_PRESSURE, HIGH_USAGE, HIGH_RATE, MEDIUM_RATE = 40, 55, 20, 10
SLA_MINUTES, OTHER_MINUTES = {"critical": 60, "high": 120, "medium": 180}, 240


def zone_usage_daily(readings: DataFrame) -> DataFrame:
    """Use by day, zone and kind of meter, from readings with zones."""
    return readings.groupBy(F.to_date("event_timestamp").alias("usage_date"), "service_zone_id", "zone_name", "zone_city", "meter_type").agg(
        F.count(F.lit(1)).alias("reading_count"), F.count_distinct("meter_id").alias("meter_count"), exact_total(F.col("usage_value")).alias("total_usage"), exact_average(F.col("usage_value")).alias("average_usage"), exact_average(F.col("pressure_psi")).alias("average_pressure_psi")
    )


def suspicious() -> Column:
    """Low pressure or high use; an unknown pressure says nothing."""
    return (F.col("pressure_psi") < LOW_PRESSURE) | (F.col("usage_value") > HIGH_USAGE)


def leak_risk_by_zone(readings: DataFrame) -> DataFrame:
    """Suspicious water readings by day and zone; the level follows from the rounded rate."""
    water = readings.where(F.col("meter_type") == "water")
    counted = water.groupBy(F.to_date("event_timestamp").alias("usage_date"), "service_zone_id", "zone_name").agg(F.count(F.lit(1)).alias("water_readings"), count_if(suspicious()).alias("suspicious_readings"))
    rated = counted.withColumn("suspicious_rate_pct", percentage(F.col("suspicious_readings"), F.col("water_readings")))
    rate = F.col("suspicious_rate_pct")
    return rated.withColumn("leak_risk_level", F.when(rate >= HIGH_RATE, "high").when(rate >= MEDIUM_RATE, "medium").otherwise("low"))


def outage_sla(matches: DataFrame) -> DataFrame:
    """Each matched outage with the readings near it, the whole minutes to its end and whether that met the target; one not resolved didn't."""
    keys = ["outage_id", "service_zone_id", "zone_name", "outage_event_type", "outage_severity", "outage_event_timestamp", "resolved_timestamp"]
    found = matches.groupBy(*keys).agg(F.count_distinct("meter_event_id").alias("matched_meter_readings"))
    target = F.lit(OTHER_MINUTES)
    for severity, minutes in SLA_MINUTES.items():
        target = F.when(F.col("outage_severity") == severity, minutes).otherwise(target)
    timed = found.withColumn("actual_duration_minutes", F.timestamp_diff("MINUTE", "outage_event_timestamp", "resolved_timestamp")).withColumn("sla_target_minutes", target)
    return timed.withColumn("sla_met", F.when(F.col("resolved_timestamp").isNull(), False).otherwise(F.col("actual_duration_minutes") <= F.col("sla_target_minutes")))


def customer_360(dimension: DataFrame, readings: DataFrame, billing: DataFrame) -> DataFrame:
    """Every current customer with totals of its meters and bills, zero where there are none.

    Both sides are aggregated by customer before they are joined, so each join is of one row to one row on the same key.
    """
    water, electric = F.col("meter_type") == "water", F.col("meter_type") == "electric"
    meters = readings.groupBy("customer_id").agg(F.count_distinct("meter_id").alias("meter_count"), sum_if(water, F.col("usage_value")).alias("water_usage_gallons"), sum_if(electric, F.col("usage_value")).alias("electric_usage_kwh"))
    month = F.when(F.col("billing_month").isNotNull(), F.struct("billing_month", "bill_id"))  # a bill without a month is never the latest
    bills = billing.groupBy("customer_id").agg(
        exact_total(F.col("usage_gallons")).alias("billed_water_usage_gallons"), exact_total(F.col("bill_amount_usd")).alias("total_bill_amount_usd"), F.max_by("payment_status", month).alias("latest_payment_status")
    )
    joined = dimension.where("is_current").select("customer_id", "customer_name", "segment", "service_zone_id", "account_status").join(meters, "customer_id", "left").join(bills, "customer_id", "left")
    amounts = ["water_usage_gallons", "electric_usage_kwh", "billed_water_usage_gallons", "total_bill_amount_usd"]
    zeros = {"meter_count": F.coalesce("meter_count", F.lit(0).cast("long"))} | {c: F.coalesce(c, F.lit(0.0)) for c in amounts}
    return joined.withColumns(zeros)


def data_quality_summary(quality: DataFrame, dedup: DataFrame) -> DataFrame:
    """The latest batch's quality beside the latest dedup figures; always one row."""
    latest = lambda names, key: [F.max_by(n, key).alias(n) for n in names]
    left = quality.agg(*latest(["total_records", "valid_records", "invalid_records", "invalid_rate_pct"], "processed_at"))
    right = dedup.agg(*latest(["source_records", "deduplicated_records", "duplicates_removed", "duplicate_rate_pct"], "measured_at"))
    return left.crossJoin(right)  # one row each


def data_quality_cumulative(quality: DataFrame) -> DataFrame:
    """All batches together, which the summary doesn't give."""
    total = quality.agg(*(F.sum(c).alias(c) for c in ("total_records", "valid_records", "invalid_records")))
    return total.withColumn("invalid_rate_pct", percentage(F.col("invalid_records"), F.col("total_records")))


def table_counts(**tables: DataFrame) -> DataFrame:
    """A labelled row count for each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out
