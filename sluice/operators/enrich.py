"""Joins of readings with zones and outages. Each condition is written once, for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far apart a reading and an outage may be, and how late rows of a stream may come.
REACH = "6 HOURS"
DELAY = "2 days"
ZONE_COLUMNS = {"zone_name": "zone_name", "city": "zone_city", "state": "zone_state", "pressure_band": "pressure_band", "service_priority": "service_priority", "centroid_latitude": "centroid_latitude", "centroid_longitude": "centroid_longitude"}


def with_zones(readings: DataFrame, zones: DataFrame) -> DataFrame:
    """Each reading with its zone's columns, null for an unknown zone.

    readings may be a stream. Spark broadcasts the zones if their size is under spark.sql.autoBroadcastJoinThreshold and shuffles otherwise, so no size is taken for granted.
    """
    small = zones.select(F.col("zone_id").alias("__zone"), *(F.col(a).alias(b) for a, b in ZONE_COLUMNS.items()))
    return readings.join(small, readings["service_zone_id"] == F.col("__zone"), "left").drop("__zone")


def _sides(readings: DataFrame, outages: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = readings.withColumn("meter_event_timestamp", F.col("event_timestamp")).alias("meter")
    return left, outages.alias("outage")


def match_outages(readings: DataFrame, outages: DataFrame, reach: str = REACH, delay: str = DELAY) -> DataFrame:
    """Readings and outages of the same meter at most reach apart, both ends included; one row for each such pair.

    Two streams get a watermark each, and the bounds let Spark drop old state on both sides. For batches of hot meters use match_outages_bucketed.
    """
    left, right = _sides(readings, outages)
    if readings.isStreaming or outages.isStreaming:
        left = readings.withColumn("meter_event_timestamp", F.col("event_timestamp")).withWatermark("meter_event_timestamp", delay).alias("meter")
        right = outages.withWatermark("outage_event_timestamp", delay).alias("outage")
    on = F.expr(f"meter.meter_id = outage.meter_id AND outage.outage_event_timestamp >= meter.meter_event_timestamp - INTERVAL {reach} AND outage.outage_event_timestamp <= meter.meter_event_timestamp + INTERVAL {reach}")
    return _matched(left.join(right, on, "inner"))


def match_outages_bucketed(readings: DataFrame, outages: DataFrame, hours: int = 6) -> DataFrame:
    """The same pairs for batches, by meter and slice of time: a meter with a large part of all rows is spread over its time slices, and a pair is compared only within neighbouring ones. Outages, the fewer rows, are those repeated for neighbouring slices."""
    seconds = hours * 3600
    left, right = _sides(readings, outages)
    left = left.withColumn("__slice", F.floor(F.unix_timestamp("meter_event_timestamp") / seconds)).alias("meter")
    right = right.withColumn("__slice", F.explode(F.array(*(F.floor(F.unix_timestamp("outage_event_timestamp") / seconds) + k for k in (-1, 0, 1))))).alias("outage")
    on = F.expr(f"meter.meter_id = outage.meter_id AND meter.__slice = outage.__slice AND outage.outage_event_timestamp >= meter.meter_event_timestamp - INTERVAL {hours} HOURS AND outage.outage_event_timestamp <= meter.meter_event_timestamp + INTERVAL {hours} HOURS")
    return _matched(left.join(right, on, "inner"))


def _matched(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("meter.event_id").alias("meter_event_id"),
        "meter.meter_id",
        "meter.customer_id",
        "meter.service_zone_id",
        "meter.zone_name",
        "meter.meter_event_timestamp",
        "meter.usage_value",
        "meter.pressure_psi",
        "outage.outage_id",
        "outage.outage_event_type",
        "outage.outage_severity",
        "outage.estimated_duration_minutes",
        "outage.outage_event_timestamp",
        "outage.resolved_timestamp",
    )
