"""Schemas of raw entities and of payloads, as DDL. Streams need them, and explicit types beat inference at any size."""

from __future__ import annotations

from pyspark.sql.types import StructType

_EVENT = "event_id string, source_system string, source_entity string, event_timestamp string"

METER = _EVENT + (
    ", meter_id string, customer_id string, service_zone_id string, meter_type string, usage_value double, usage_unit string, pressure_psi double, battery_pct int, firmware_version string, meter_status string, ingestion_hint string, is_intentionally_invalid boolean, duplicate_copy boolean"
)
OUTAGE = _EVENT + ", outage_id string, meter_id string, customer_id string, service_zone_id string, event_type string, severity string, estimated_duration_minutes int, resolved_timestamp string"
CUSTOMER = "customer_id string, customer_name string, segment string, service_zone_id string, email string, phone string, address_line1 string, city string, state string, postal_code string, account_status string, created_at string"
CDC = f"cdc_event_id string, source_system string, source_entity string, operation string, sequence_num bigint, event_timestamp string, customer struct<{', '.join(x.replace(' ', ': ', 1) for x in CUSTOMER.split(', '))}>"
BILLING = "bill_id string, source_system string, source_entity string, customer_id string, service_zone_id string, usage_gallons double, bill_amount_usd double, payment_status string, generated_timestamp string"
ZONES = "zone_id string, zone_name string, city string, state string, pressure_band string, service_priority string, centroid_latitude double, centroid_longitude double"


def struct(ddl: str, *partition: str) -> StructType:
    """The type of ddl, with partition columns (such as "ingest_date date") at its end."""
    return StructType.fromDDL(", ".join([ddl, *partition]))
