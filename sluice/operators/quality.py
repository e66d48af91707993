"""Rules and parsing of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.expressions import event_time
from ..functions.rules import Rule, RuleSet, missing, not_in, outside

# The accepted domains and the codes that consumers read.
METER_TYPES = ("water", "electric")
METER_STATES = ("active", "maintenance", "offline")
OPERATIONS = ("insert", "update", "delete")
PAYMENTS = ("paid", "late", "unpaid")
LINEAGE = ("source_entity", "source_system", "schema_version", "_source_file", "_ingestion_timestamp", "_load_date")


def meter_rules() -> RuleSet:
    return RuleSet(
        (
            missing("event_id"),
            missing("meter_id"),
            missing("customer_id"),
            missing("service_zone_id"),
            missing("event_timestamp", "invalid_event_timestamp"),
            missing("usage_value"),
            Rule("negative_usage_value", F.col("usage_value") < 0),
            not_in("meter_type", METER_TYPES, "invalid_meter_type"),
            not_in("meter_status", METER_STATES, "invalid_meter_status"),
            outside("battery_pct", "invalid_battery_percentage", 0, 100),
            Rule("invalid_water_pressure", (F.col("meter_type") == "water") & (F.col("pressure_psi").isNull() | (F.col("pressure_psi") <= 0))),
        )
    )


def cdc_rules() -> RuleSet:
    return RuleSet((missing("cdc_event_id"), missing("customer_id"), not_in("operation", OPERATIONS, "invalid_operation"), missing("sequence_num"), missing("event_timestamp", "invalid_event_timestamp")))


def billing_rules() -> RuleSet:
    return RuleSet(
        (
            missing("bill_id"),
            missing("customer_id"),
            missing("service_zone_id"),
            missing("billing_month", "invalid_billing_month"),
            outside("usage_gallons", "invalid_usage_gallons", 0),
            outside("bill_amount_usd", "invalid_bill_amount", 0),
            not_in("payment_status", PAYMENTS, "invalid_payment_status"),
            missing("generated_timestamp", "invalid_generated_timestamp"),
        )
    )


def _payload(bronze: DataFrame, entity: str, ddl: str, *extra: str) -> DataFrame:
    """Rows of one entity with the payload parsed once, under p. Unknown keys are dropped, missing ones are null, broken text gives nulls."""
    return bronze.where(F.col("source_entity") == entity).withColumn("p", F.from_json("raw_payload", schemas.struct(ddl, *extra)))


def parse_meters(bronze: DataFrame) -> DataFrame:
    """Multiplexed raw rows to typed readings with their lineage and payload. Batch or stream."""
    rows = _payload(bronze, "meter_readings", schemas.METER, "ingest_date string")
    own = [f.name for f in schemas.struct(schemas.METER) if f.name not in ("source_system", "source_entity", "event_timestamp")]
    return rows.select(*(F.col(f"p.{c}") for c in own[:1]), event_time(F.col("p.event_timestamp")).alias("event_timestamp"), *(F.col(f"p.{c}") for c in own[1:] if c != "duplicate_copy"), F.col("p.ingest_date"), *(c for c in LINEAGE if c in bronze.columns), "raw_payload")


def parse_outages(bronze: DataFrame) -> DataFrame:
    """Multiplexed raw rows to typed outages; there are no rules for them."""
    rows = _payload(bronze, "outage_events", schemas.OUTAGE)
    plain = ("outage_id", "meter_id", "customer_id", "service_zone_id", "estimated_duration_minutes")
    return rows.select("p.event_id", *(F.col(f"p.{c}") for c in plain), F.col("p.event_type").alias("outage_event_type"), F.col("p.severity").alias("outage_severity"), event_time(F.col("p.event_timestamp")).alias("outage_event_timestamp"), event_time(F.col("p.resolved_timestamp")).alias("resolved_timestamp"))


def parse_cdc(bronze: DataFrame) -> DataFrame:
    """Multiplexed raw rows to typed customer changes."""
    rows = _payload(bronze, "customer_cdc", schemas.CDC)
    names = [f.name for f in schemas.struct(schemas.CUSTOMER) if f.name != "created_at"]
    return rows.select("p.cdc_event_id", "p.operation", "p.sequence_num", event_time(F.col("p.event_timestamp")).alias("event_timestamp"), *(F.col(f"p.customer.{c}") for c in names), *(c for c in LINEAGE if c in bronze.columns), "raw_payload")


def parse_billing(bronze: DataFrame) -> DataFrame:
    """Raw bills to typed ones; text that is no date, number or time becomes null."""
    typed = {
        "billing_month": F.to_date(F.col("billing_month").try_cast("date")),
        "usage_gallons": F.col("usage_gallons").try_cast("double"),
        "bill_amount_usd": F.col("bill_amount_usd").try_cast("double"),
        "generated_timestamp": event_time(F.col("generated_timestamp").cast("string")),
    }
    return bronze.withColumns(typed)
