"""Rules, history, joins and feeds on rows written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions import rules
from sluice.functions.expressions import event_time, rounded
from sluice.operators import cdc, changefeed, dedup, enrich, gold, layout, quality

T0 = dt.datetime(2024, 5, 1, 12)
GOOD = {"event_id": "e", "meter_id": "m", "customer_id": "c", "service_zone_id": "z", "event_timestamp": T0, "usage_value": 1.0, "meter_type": "water", "meter_status": "active", "battery_pct": 50, "pressure_psi": 50.0}
METER = "event_id string, meter_id string, customer_id string, service_zone_id string, event_timestamp timestamp, usage_value double, meter_type string, meter_status string, battery_pct int, pressure_psi double"


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, ""),
        ({"event_id": None}, "missing_event_id"),
        ({"meter_id": None}, "missing_meter_id"),
        ({"customer_id": None}, "missing_customer_id"),
        ({"service_zone_id": None}, "missing_service_zone_id"),
        ({"event_timestamp": None}, "invalid_event_timestamp"),
        ({"usage_value": None}, "missing_usage_value"),
        ({"usage_value": -1.0}, "negative_usage_value"),
        ({"meter_type": "gas"}, "invalid_meter_type"),
        ({"meter_type": None, "pressure_psi": None}, "invalid_meter_type"),
        ({"meter_status": "unknown_status"}, "invalid_meter_status"),
        ({"battery_pct": 101}, "invalid_battery_percentage"),
        ({"battery_pct": None}, "invalid_battery_percentage"),
        ({"pressure_psi": 0.0}, "invalid_water_pressure"),
        ({"meter_type": "electric", "pressure_psi": None}, ""),
        ({"meter_id": None, "usage_value": -2.0}, "missing_meter_id; negative_usage_value"),
    ],
)
def test_meter_rules(spark, change, error):
    row = GOOD | change
    df = spark.createDataFrame([tuple(row.values())], METER)
    assert quality.meter_rules().mark(df).first()["quality_error"] == error


@pytest.mark.parametrize(
    ("change", "error"),
    [({}, ""), ({"cdc_event_id": None}, "missing_cdc_event_id"), ({"customer_id": None}, "missing_customer_id"), ({"operation": "merge"}, "invalid_operation"), ({"sequence_num": None}, "missing_sequence_num"), ({"event_timestamp": None}, "invalid_event_timestamp")],
)
def test_cdc_rules(spark, change, error):
    row = {"cdc_event_id": "1", "customer_id": "c", "operation": "insert", "sequence_num": 1, "event_timestamp": T0} | change
    df = spark.createDataFrame([tuple(row.values())], "cdc_event_id string, customer_id string, operation string, sequence_num long, event_timestamp timestamp")
    assert quality.cdc_rules().mark(df).first()["quality_error"] == error


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, ""),
        ({"bill_id": None}, "missing_bill_id"),
        ({"customer_id": None}, "missing_customer_id"),
        ({"service_zone_id": None}, "missing_service_zone_id"),
        ({"billing_month": "soon"}, "invalid_billing_month"),
        ({"usage_gallons": "-1"}, "invalid_usage_gallons"),
        ({"bill_amount_usd": "much"}, "invalid_bill_amount"),
        ({"payment_status": "void"}, "invalid_payment_status"),
        ({"generated_timestamp": "2024-01-02"}, "invalid_generated_timestamp"),
    ],
)
def test_billing_rules(spark, change, error):
    row = {"bill_id": "b", "customer_id": "c", "service_zone_id": "z", "billing_month": "2024-01-01", "usage_gallons": "1.5", "bill_amount_usd": "2", "payment_status": "paid", "generated_timestamp": "2024-01-02T03:04:05Z"} | change
    from sluice.operators.billing import normalise

    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    assert normalise(df).first()["quality_error"] == error


def test_metrics_of_nothing(spark):
    empty = quality.meter_rules().mark(spark.createDataFrame([], METER))
    assert rules.metrics(empty).collect() == [(0, 0, 0, None)]
    nothing = spark.createDataFrame([], "event_id string")
    assert dedup.dedup_metrics(nothing, nothing).first()["duplicate_rate_pct"] == 0.0


def test_rounding_is_half_up_on_decimals(spark):
    got = spark.createDataFrame([(1.005,), (0.285,), (2.5,)], "x double").select(rounded(F.col("x"))).collect()
    assert [r[0] for r in got] == [1.01, 0.29, 2.5]


def _history(spark, events):
    names = ("cdc_event_id", "customer_id", "operation", "sequence_num", "event_timestamp")
    rows = [(str(i), "c", op, seq, T0 + dt.timedelta(hours=i)) for i, (op, seq) in enumerate(events)]
    df = spark.createDataFrame(rows, "cdc_event_id string, customer_id string, operation string, sequence_num long, event_timestamp timestamp")
    assert df.columns == list(names)
    return cdc.scd2(df, attributes=("customer_id",)).orderBy("effective_start_timestamp").collect()


def test_scd2(spark):
    rows = _history(spark, [("insert", 1), ("update", 2), ("delete", 3), ("insert", 4)])
    assert [(r.is_current, r.closed_by_delete) for r in rows] == [(False, False), (False, True), (True, None)]
    assert rows[0].effective_end_timestamp == rows[1].effective_start_timestamp
    assert _history(spark, [("delete", 1)]) == []
    assert [r.cdc_event_id for r in _history(spark, [("insert", 1), ("update", 1)]) if r.is_current] == ["1"]


def test_change_feed(spark):
    kind = "k int, v string"
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (4, "d")], kind)
    after = spark.createDataFrame([(1, "a"), (2, "B"), (5, "e"), (4, "d")], kind)
    got = changefeed.changes(before, after, 7, F.lit(T0).cast("timestamp"), ("k",)).drop("_commit_timestamp").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(2, "b", "update_preimage", 7), (2, "B", "update_postimage", 7), (3, None, "delete", 7), (5, "e", "insert", 7), (4, "d", "delete", 7)], key=repr)
    assert changefeed.overwrite_changes(before, after, 1, F.current_timestamp()).count() == 9


def test_joins(spark):
    hours = lambda h: T0 + dt.timedelta(hours=h)
    readings = spark.createDataFrame([("e1", "m", "c", "z1", T0, 1.0, 50.0), ("e2", "m", "c", "??", hours(100), 1.0, 50.0)], "event_id string, meter_id string, customer_id string, service_zone_id string, event_timestamp timestamp, usage_value double, pressure_psi double")
    zones = spark.createDataFrame([("z1", "Z", "C", "S", "low", "normal", 1.0, 2.0)], "zone_id string, zone_name string, city string, state string, pressure_band string, service_priority string, centroid_latitude double, centroid_longitude double")
    zoned = enrich.with_zones(readings, zones)
    assert {r.event_id: r.zone_name for r in zoned.collect()} == {"e1": "Z", "e2": None}
    at = [hours(-6), hours(6), hours(6) + dt.timedelta(seconds=1)]
    outages = spark.createDataFrame([(f"o{i}", "m", "leak", "high", 5, t, None) for i, t in enumerate(at)], "outage_id string, meter_id string, outage_event_type string, outage_severity string, estimated_duration_minutes int, outage_event_timestamp timestamp, resolved_timestamp timestamp")
    for f in (enrich.match_outages, enrich.match_outages_bucketed):
        assert sorted(r.outage_id for r in f(zoned, outages).collect()) == ["o0", "o1"]


def test_sla(spark):
    kind = "outage_id string, service_zone_id string, zone_name string, outage_event_type string, outage_severity string, outage_event_timestamp timestamp, resolved_timestamp timestamp, meter_event_id string"
    end = lambda m, s=0: T0 + dt.timedelta(minutes=m, seconds=s)
    rows = [("a", "critical", end(60)), ("b", "high", None), ("c", "low", end(240, 59)), ("d", "medium", end(181))]
    got = gold.outage_sla(spark.createDataFrame([(i, "z", "Z", "t", s, T0, e, "r") for i, s, e in rows], kind)).collect()
    assert {r.outage_id: (r.actual_duration_minutes, r.sla_met) for r in got} == {"a": (60, True), "b": (None, False), "c": (240, True), "d": (181, False)}


def test_leak_levels(spark):
    def rows(day, suspicious, n):
        return [(T0 + dt.timedelta(days=day), "z", "Z", "water", 56.0 if i < suspicious else 10.0, None if i % 2 else 50.0) for i in range(n)]

    df = spark.createDataFrame(rows(0, 1, 5) + rows(1, 1, 10) + rows(2, 1, 11), "event_timestamp timestamp, service_zone_id string, zone_name string, meter_type string, usage_value double, pressure_psi double")
    assert [r.leak_risk_level for r in gold.leak_risk_by_zone(df).orderBy("usage_date").collect()] == ["high", "medium", "low"]


def test_customer_without_anything(spark):
    dimension = spark.createDataFrame([("c", "n", "s", "z", "a", True), ("old", "n", "s", "z", "a", False)], "customer_id string, customer_name string, segment string, service_zone_id string, account_status string, is_current boolean")
    readings = spark.createDataFrame([], "customer_id string, meter_id string, meter_type string, usage_value double")
    bills = spark.createDataFrame([], "customer_id string, bill_amount_usd double, usage_gallons double, payment_status string, billing_month date, bill_id string")
    (row,) = gold.customer_360(dimension, readings, bills).collect()
    assert (row.customer_id, row.meter_count, row.total_bill_amount_usd, row.latest_payment_status) == ("c", 0, 0.0, None)


def test_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+07", "2024-01-02T03:04:05+07:00", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(event_time(F.col("t")).isNotNull()).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_plans(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    from sluice.plans import adapters as a

    sf = "/root/testdata/sf0.001"
    water = gold.leak_risk_by_zone(enrich.with_zones(a.readings(spark, sf), a.zones(spark, sf)))
    assert "BroadcastHashJoin" in plan(water) and "PushedFilters: [" in plan(water)
    history = plan(cdc.scd2(a.changes(spark, sf), attributes=("customer_id",)))
    assert history.count("Window [") == 1
    assert "LocalTableScan <empty>" in plan(layout.empty_clone(a.readings(spark, sf)))
