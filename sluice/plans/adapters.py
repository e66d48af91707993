"""The driver's tables as the engine's entities, in DataFrames and in SQL. Dirt and repeats are planted by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    zone = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("string").alias("service_zone_id"))
    return events.withColumn("k", k).join(zone, "user_id")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    water = F.col("event_type").isin("click", "view")
    return _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("event_timestamp"),
        F.col("user_id").cast("string").alias("meter_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        "service_zone_id",
        F.when(water, "water").otherwise("electric").alias("meter_type"),
        (F.col("value") / 5).alias("usage_value"),
        F.when(water, 35 + F.lit(0.55).cast("double") * F.col("k")).alias("pressure_psi"),
        F.col("k").alias("battery_pct"),
        F.lit("active").alias("meter_status"),
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """readings as producers send them: times are text, and some rows are wrong."""
    n = F.col("event_id").cast("long")
    hit = lambda m: n % m == 0
    return readings(spark, sf_dir).withColumns(
        {
            "meter_id": F.when(~hit(89), F.col("meter_id")),
            "event_timestamp": F.when(hit(83), "not-a-timestamp").otherwise(F.date_format("event_timestamp", ISO)),
            "usage_value": F.when(hit(97), -F.abs("usage_value") - 1).when(~hit(211), F.col("usage_value")),
            "meter_type": F.when(hit(101), "gas").otherwise(F.col("meter_type")),
            "meter_status": F.when(hit(103), "unknown_status").otherwise(F.col("meter_status")),
            "battery_pct": F.when(hit(107), 101).otherwise(F.col("battery_pct")),
            "pressure_psi": F.when(~hit(109), F.col("pressure_psi")),
            "service_zone_id": F.when(~hit(113), F.col("service_zone_id")),
            "customer_id": F.when(~hit(127), F.col("customer_id")),
        }
    )


def with_repeats(df: DataFrame) -> DataFrame:
    """Every fiftieth reading twice."""
    return df.unionByName(df.where(F.col("event_id").cast("long") % 50 == 0))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).where(key != 24).select(
        key.cast("string").alias("zone_id"),
        F.col("n_name").alias("zone_name"),
        F.col("r_name").alias("city"),
        F.col("r_name").alias("state"),
        F.when(key % 3 == 0, "low").when(key % 3 == 1, "standard").otherwise("high").alias("pressure_band"),
        F.when(key % 2 == 0, "normal").otherwise("critical").alias("service_priority"),
        key.cast("double").alias("centroid_latitude"),
        (-key).cast("double").alias("centroid_longitude"),
    )


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    severity = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("critical")
    return _events(spark, sf_dir).where("event_type = 'error'").select(
        F.concat(F.lit("out_"), F.col("event_id").cast("string")).alias("outage_id"),
        F.col("user_id").cast("string").alias("meter_id"),
        F.when(k % 2 == 0, "pressure_drop").otherwise("meter_offline").alias("outage_event_type"),
        severity.alias("outage_severity"),
        (k * 3).cast("int").alias("estimated_duration_minutes"),
        F.col("ts").alias("outage_event_timestamp"),
        F.when(k % 10 != 9, F.timestamp_add("MINUTE", k * 3, F.col("ts"))).alias("resolved_timestamp"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of customers, some of them wrong."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, hit = F.col("o_orderkey"), lambda m: F.col("o_orderkey") % m == 0
    status = F.col("o_orderstatus")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        key.cast("string").alias("cdc_event_id"),
        F.when(hit(103), "merge").when(status == "F", "insert").when(status == "O", "update").otherwise("delete").alias("operation"),
        F.when(~hit(107), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long") * 100_000_000 + key).alias("sequence_num"),
        F.col("o_orderdate").cast("timestamp").alias("event_timestamp"),
        F.when(~hit(101), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("service_zone_id"),
        F.col("o_orderpriority").alias("account_status"),
    )


def raw_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bills with text for dates and times, some of them wrong."""
    orders = table(spark, sf_dir, "orders")
    hit = lambda m: F.col("o_orderkey") % m == 0
    at, rank = F.col("o_orderdate").cast("timestamp"), F.substring("o_orderpriority", 1, 1)
    return orders.select(
        F.col("o_orderkey").cast("string").alias("bill_id"),
        F.when(~hit(101), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(~hit(103), (F.col("o_custkey") % 25).cast("string")).alias("service_zone_id"),
        F.when(hit(127), "soon").otherwise(F.date_format(F.trunc(at.cast("date"), "MM"), "yyyy-MM-dd")).alias("billing_month"),
        F.when(hit(131), -1.0).otherwise(F.col("o_totalprice") / 10).alias("usage_gallons"),
        F.when(hit(107), -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("bill_amount_usd"),
        F.when(hit(109), "void").when(rank.isin("1", "2"), "paid").when(rank == "3", "late").otherwise("unpaid").alias("payment_status"),
        F.when(hit(113), "not-a-timestamp").otherwise(F.date_format(at, ISO)).alias("generated_timestamp"),
    )


# The same entities in SQL.
SQL = {
    "ev": """ev AS (SELECT e.*, (e.props::json ->> '$.k')::int AS k, c.c_nationkey::varchar AS service_zone_id
        FROM events e JOIN customer c ON e.user_id = c.c_custkey)""",
    "readings": """readings AS (SELECT event_id::varchar AS event_id, ts AS event_timestamp, user_id::varchar AS meter_id, user_id::varchar AS customer_id,
        service_zone_id, CASE WHEN event_type IN ('click', 'view') THEN 'water' ELSE 'electric' END AS meter_type, value / 5 AS usage_value,
        CASE WHEN event_type IN ('click', 'view') THEN 35 + 0.55::double * k END AS pressure_psi, k AS battery_pct, 'active' AS meter_status FROM ev)""",
    "zones": """zones AS (SELECT n_nationkey::varchar AS zone_id, n_name AS zone_name, r_name AS zone_city, r_name AS zone_state,
        CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'standard' ELSE 'high' END AS pressure_band,
        CASE n_nationkey % 2 WHEN 0 THEN 'normal' ELSE 'critical' END AS service_priority,
        n_nationkey::double AS centroid_latitude, (-n_nationkey)::double AS centroid_longitude
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24)""",
    "zoned": "zoned AS (SELECT r.*, z.* EXCLUDE (zone_id) FROM readings r LEFT JOIN zones z ON r.service_zone_id = z.zone_id)",
    "outages": """outages AS (SELECT 'out_' || event_id AS outage_id, user_id::varchar AS meter_id, CASE WHEN k % 2 = 0 THEN 'pressure_drop' ELSE 'meter_offline' END AS outage_event_type,
        CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS outage_severity, (k * 3)::int AS estimated_duration_minutes,
        ts AS outage_event_timestamp, CASE WHEN k % 10 <> 9 THEN ts + to_minutes(k * 3) END AS resolved_timestamp FROM ev WHERE event_type = 'error')""",
    "matches": """matches AS (SELECT m.event_id AS meter_event_id, m.meter_id, m.customer_id, m.service_zone_id, m.zone_name, m.event_timestamp AS meter_event_timestamp,
        m.usage_value, m.pressure_psi, o.outage_id, o.outage_event_type, o.outage_severity, o.outage_event_timestamp, o.resolved_timestamp, o.estimated_duration_minutes
        FROM zoned m JOIN outages o ON m.meter_id = o.meter_id AND o.outage_event_timestamp BETWEEN m.event_timestamp - INTERVAL 6 HOUR AND m.event_timestamp + INTERVAL 6 HOUR)""",
    "raw": """raw AS (SELECT event_id, CASE WHEN n % 89 <> 0 THEN meter_id END AS meter_id, CASE WHEN n % 127 <> 0 THEN customer_id END AS customer_id,
        CASE WHEN n % 113 <> 0 THEN service_zone_id END AS service_zone_id, CASE WHEN n % 83 <> 0 THEN date_trunc('second', event_timestamp) END AS event_timestamp,
        CASE WHEN n % 97 = 0 THEN -abs(usage_value) - 1 WHEN n % 211 <> 0 THEN usage_value END AS usage_value, CASE WHEN n % 101 = 0 THEN 'gas' ELSE meter_type END AS meter_type,
        CASE WHEN n % 103 = 0 THEN 'unknown_status' ELSE meter_status END AS meter_status, CASE WHEN n % 107 = 0 THEN 101 ELSE battery_pct END AS battery_pct,
        CASE WHEN n % 109 <> 0 THEN pressure_psi END AS pressure_psi FROM (SELECT *, event_id::bigint AS n FROM readings))""",
    "marked": """marked AS (SELECT *, concat_ws('; ', CASE WHEN event_id IS NULL THEN 'missing_event_id' END, CASE WHEN meter_id IS NULL THEN 'missing_meter_id' END,
        CASE WHEN customer_id IS NULL THEN 'missing_customer_id' END, CASE WHEN service_zone_id IS NULL THEN 'missing_service_zone_id' END,
        CASE WHEN event_timestamp IS NULL THEN 'invalid_event_timestamp' END, CASE WHEN usage_value IS NULL THEN 'missing_usage_value' END,
        CASE WHEN usage_value < 0 THEN 'negative_usage_value' END, CASE WHEN meter_type IS NULL OR meter_type NOT IN ('water', 'electric') THEN 'invalid_meter_type' END,
        CASE WHEN meter_status IS NULL OR meter_status NOT IN ('active', 'maintenance', 'offline') THEN 'invalid_meter_status' END,
        CASE WHEN battery_pct IS NULL OR battery_pct < 0 OR battery_pct > 100 THEN 'invalid_battery_percentage' END,
        CASE WHEN meter_type = 'water' AND (pressure_psi IS NULL OR pressure_psi <= 0) THEN 'invalid_water_pressure' END) AS quality_error FROM raw)""",
    "ch": """ch AS (SELECT o_orderkey::varchar AS cdc_event_id, CASE WHEN o_orderkey % 103 = 0 THEN 'merge' WHEN o_orderstatus = 'F' THEN 'insert' WHEN o_orderstatus = 'O' THEN 'update' ELSE 'delete' END AS operation,
        CASE WHEN o_orderkey % 107 <> 0 THEN date_diff('day', DATE '1990-01-01', o_orderdate::date) * 100000000 + o_orderkey END AS sequence_num, o_orderdate AS event_timestamp,
        CASE WHEN o_orderkey % 101 <> 0 THEN o_custkey::varchar END AS customer_id, c_name AS customer_name, c_mktsegment AS segment, c_nationkey::varchar AS service_zone_id, o_orderpriority AS account_status
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "ch_marked": """ch_marked AS (SELECT *, concat_ws('; ', CASE WHEN cdc_event_id IS NULL THEN 'missing_cdc_event_id' END, CASE WHEN customer_id IS NULL THEN 'missing_customer_id' END,
        CASE WHEN operation IS NULL OR operation NOT IN ('insert', 'update', 'delete') THEN 'invalid_operation' END, CASE WHEN sequence_num IS NULL THEN 'missing_sequence_num' END,
        CASE WHEN event_timestamp IS NULL THEN 'invalid_event_timestamp' END) AS quality_error FROM ch)""",
    "dim": """dim AS (SELECT customer_id, customer_name, segment, service_zone_id, account_status, event_timestamp AS effective_start_timestamp, nt AS effective_end_timestamp,
        nt IS NULL AS is_current, nop = 'delete' AS closed_by_delete, sequence_num, cdc_event_id FROM (SELECT *, lead(event_timestamp) OVER w AS nt, lead(operation) OVER w AS nop
        FROM ch_marked WHERE quality_error = '' WINDOW w AS (PARTITION BY customer_id ORDER BY sequence_num, event_timestamp, cdc_event_id)) WHERE operation <> 'delete')""",
    "bills": """bills AS (SELECT *, concat_ws('; ', CASE WHEN bill_id IS NULL THEN 'missing_bill_id' END, CASE WHEN customer_id IS NULL THEN 'missing_customer_id' END,
        CASE WHEN service_zone_id IS NULL THEN 'missing_service_zone_id' END, CASE WHEN billing_month IS NULL THEN 'invalid_billing_month' END,
        CASE WHEN usage_gallons IS NULL OR usage_gallons < 0 THEN 'invalid_usage_gallons' END, CASE WHEN bill_amount_usd IS NULL OR bill_amount_usd < 0 THEN 'invalid_bill_amount' END,
        CASE WHEN payment_status IS NULL OR payment_status NOT IN ('paid', 'late', 'unpaid') THEN 'invalid_payment_status' END,
        CASE WHEN generated_timestamp IS NULL THEN 'invalid_generated_timestamp' END) AS quality_error FROM (SELECT o_orderkey::varchar AS bill_id,
        CASE WHEN o_orderkey % 101 <> 0 THEN o_custkey::varchar END AS customer_id, CASE WHEN o_orderkey % 103 <> 0 THEN (o_custkey % 25)::varchar END AS service_zone_id,
        CASE WHEN o_orderkey % 127 <> 0 THEN date_trunc('month', o_orderdate)::date END AS billing_month, CASE WHEN o_orderkey % 131 = 0 THEN -1.0::double ELSE o_totalprice / 10 END AS usage_gallons,
        CASE WHEN o_orderkey % 107 = 0 THEN -o_totalprice ELSE o_totalprice END AS bill_amount_usd,
        CASE WHEN o_orderkey % 109 = 0 THEN 'void' WHEN o_orderpriority[1] IN ('1', '2') THEN 'paid' WHEN o_orderpriority[1] = '3' THEN 'late' ELSE 'unpaid' END AS payment_status,
        CASE WHEN o_orderkey % 113 <> 0 THEN date_trunc('second', o_orderdate) END AS generated_timestamp FROM orders))""",
}
#: What each needs before it.
NEEDS = {"ev": [], "readings": ["ev"], "zones": [], "zoned": ["readings", "zones"], "outages": ["ev"], "matches": ["zoned", "outages"], "raw": ["readings"], "marked": ["raw"], "ch": [], "ch_marked": ["ch"], "dim": ["ch_marked"], "bills": []}


def sql(body: str, *names: str) -> str:
    """body with the entities that it names, and those that they need, as common tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return f"WITH {', '.join(SQL[n] for n in order)} {body}" if order else body
