"""Named queries over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expressions import count_if, event_time, exact_average, exact_total, salted_digest, sum_if, wall_time
from ..operators import benchdata, billing, cdc, changefeed, dedup, enrich, gold, layout, quality
from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    """Registers a query under its function's name; needs are the entities that sql names."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = a.sql(sql, *needs)
        return f

    return register


def _walls(df: DataFrame) -> DataFrame:
    """Instants as wall-clock time, as SQL engines without zones have them."""
    return df.select(*(wall_time(F.col(n)).alias(n) if kind == "timestamp" else F.col(n) for n, kind in df.dtypes))


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder; machine-local only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), "sluice-scratch")
    return f"{root.rstrip('/')}/sluice-{uuid.uuid4().hex}"


def _zoned(s: SparkSession, d: str) -> DataFrame:
    return enrich.with_zones(a.readings(s, d), a.zones(s, d))


def _matches(s: SparkSession, d: str) -> DataFrame:
    return enrich.match_outages(_zoned(s, d), a.outages(s, d))


def _marked(s: SparkSession, d: str) -> DataFrame:
    raw = a.raw_readings(s, d)
    return quality.meter_rules().mark(raw.withColumn("event_timestamp", event_time(F.col("event_timestamp"))))


def _cdc_marked(s: SparkSession, d: str) -> DataFrame:
    return quality.cdc_rules().mark(a.changes(s, d))


ATTRIBUTES = ("customer_id", "customer_name", "segment", "service_zone_id", "account_status")


def _dimension(s: SparkSession, d: str) -> DataFrame:
    return cdc.scd2(rules.valid(_cdc_marked(s, d)), attributes=ATTRIBUTES)


def _bills(s: SparkSession, d: str) -> DataFrame:
    return billing.normalise(a.raw_billing(s, d))


# Gold.

# Compensated sums of doubles, so they owe nothing to the engine's decimals.
AVERAGE = "round(favg({0})::decimal(38,10), 2)::double"
TOTAL = "round(fsum({0})::decimal(38,10), 2)::double"


@query(
    f"""SELECT event_timestamp::date AS usage_date, service_zone_id, zone_name, zone_city, meter_type, count(*) AS reading_count, count(DISTINCT meter_id) AS meter_count,
    {TOTAL.format("usage_value")} AS total_usage, {AVERAGE.format("usage_value")} AS average_usage, {AVERAGE.format("pressure_psi")} AS average_pressure_psi FROM zoned GROUP BY ALL""",
    "zoned",
)
def gold_zone_usage_daily(s, d):
    return gold.zone_usage_daily(_zoned(s, d))


@query(
    """SELECT *, CASE WHEN suspicious_rate_pct >= 20 THEN 'high' WHEN suspicious_rate_pct >= 10 THEN 'medium' ELSE 'low' END AS leak_risk_level FROM (
    SELECT event_timestamp::date AS usage_date, service_zone_id, zone_name, count(*) AS water_readings,
    sum(CASE WHEN pressure_psi < 40 OR usage_value > 55 THEN 1 ELSE 0 END)::bigint AS suspicious_readings,
    round((100.0::double * sum(CASE WHEN pressure_psi < 40 OR usage_value > 55 THEN 1 ELSE 0 END)::double / count(*)::double)::decimal(38,10), 2)::double AS suspicious_rate_pct
    FROM zoned WHERE meter_type = 'water' GROUP BY ALL)""",
    "zoned",
)
def gold_leak_risk_by_zone(s, d):
    return gold.leak_risk_by_zone(_zoned(s, d))


@query(
    """SELECT *, CASE WHEN resolved_timestamp IS NULL THEN false ELSE actual_duration_minutes <= sla_target_minutes END AS sla_met FROM (
    SELECT outage_id, service_zone_id, zone_name, outage_event_type, outage_severity, outage_event_timestamp, resolved_timestamp, count(DISTINCT meter_event_id) AS matched_meter_readings,
    date_sub('minute', outage_event_timestamp, resolved_timestamp) AS actual_duration_minutes, CASE outage_severity WHEN 'critical' THEN 60 WHEN 'high' THEN 120 WHEN 'medium' THEN 180 ELSE 240 END::int AS sla_target_minutes
    FROM matches GROUP BY ALL)""",
    "matches",
)
def gold_outage_sla(s, d):
    return _walls(gold.outage_sla(_matches(s, d)))


@query(
    f"""SELECT c.customer_id, customer_name, segment, service_zone_id, account_status, coalesce(meter_count, 0) AS meter_count,
    coalesce(water_usage_gallons, 0.0) AS water_usage_gallons, coalesce(electric_usage_kwh, 0.0) AS electric_usage_kwh, 
    coalesce(total_bill_amount_usd, 0.0) AS total_bill_amount_usd, coalesce(billed_water_usage_gallons, 0.0) AS billed_water_usage_gallons, latest_payment_status
    FROM (SELECT * FROM dim WHERE is_current) c LEFT JOIN (SELECT customer_id, count(DISTINCT meter_id) AS meter_count,
      {TOTAL.format("(CASE WHEN meter_type = 'water' THEN usage_value ELSE 0.0::double END)")} AS water_usage_gallons,
      {TOTAL.format("(CASE WHEN meter_type = 'electric' THEN usage_value ELSE 0.0::double END)")} AS electric_usage_kwh FROM readings GROUP BY 1) m ON c.customer_id = m.customer_id
    LEFT JOIN (SELECT customer_id, {TOTAL.format("bill_amount_usd")} AS total_bill_amount_usd, {TOTAL.format("usage_gallons")} AS billed_water_usage_gallons,
      arg_max_null(payment_status, {{'m': billing_month, 'b': bill_id}}) AS latest_payment_status FROM bills WHERE quality_error = '' GROUP BY 1) b ON c.customer_id = b.customer_id""",
    "dim",
    "readings",
    "bills",
)
def gold_customer_360(s, d):
    return gold.customer_360(_dimension(s, d), a.readings(s, d), rules.valid(_bills(s, d)))


RATE = "round((100.0::double * ({0})::double / ({1})::double)::decimal(38,10), 2)::double"
_QUALITY = f"""SELECT count(*) AS total_records, count(*) FILTER (quality_error = '') AS valid_records, count(*) FILTER (quality_error <> '') AS invalid_records,
    {RATE.format("count(*) FILTER (quality_error <> '')", "count(*)")} AS invalid_rate_pct FROM marked"""
_DEDUP = f"""SELECT count(*) AS source_records, count(DISTINCT event_id) AS deduplicated_records, count(*) - count(DISTINCT event_id) AS duplicates_removed,
    {RATE.format("count(*) - count(DISTINCT event_id)", "count(*)")} AS duplicate_rate_pct FROM (SELECT event_id FROM readings UNION ALL SELECT event_id FROM readings WHERE event_id::bigint % 50 = 0)"""


def _dedup_figures(s, d):
    source = a.with_repeats(a.readings(s, d).select("event_id"))
    return dedup.dedup_metrics(source, dedup.dedup_batch(source))


@query(f"SELECT * FROM ({_QUALITY}) CROSS JOIN ({_DEDUP})", "marked")
def gold_data_quality_summary(s, d):
    now = F.current_timestamp()
    return gold.data_quality_summary(rules.metrics(_marked(s, d)).withColumn("processed_at", now), _dedup_figures(s, d).withColumn("measured_at", now))


@query(f"SELECT total_records::bigint AS total_records, valid_records, invalid_records, invalid_rate_pct FROM ({_QUALITY})", "marked")
def gold_data_quality_cumulative(s, d):
    marked = _marked(s, d)
    half = F.col("event_id").cast("long") % 2 == 0
    batches = rules.metrics(marked.where(half)).unionByName(rules.metrics(marked.where(~half)))
    return gold.data_quality_cumulative(batches)


# Quality.


@query("SELECT event_id, quality_error FROM marked WHERE quality_error <> ''", "marked")
def meter_quality_errors(s, d):
    return rules.quarantined(_marked(s, d)).select("event_id", "quality_error")


@query("SELECT * EXCLUDE (quality_error) FROM marked WHERE quality_error = ''", "marked")
def meter_quality_valid(s, d):
    return _walls(rules.valid(_marked(s, d)))


@query("SELECT * FROM marked WHERE quality_error <> ''", "marked")
def meter_quarantine(s, d):
    return _walls(rules.quarantined(_marked(s, d)))


@query(_QUALITY, "marked")
def quality_metrics(s, d):
    return rules.metrics(_marked(s, d))


@query("SELECT code, count(*) AS n FROM (SELECT unnest(string_split(quality_error, '; ')) AS code FROM marked WHERE quality_error <> '') GROUP BY code", "marked")
def meter_error_profile(s, d):
    return rules.error_profile(_marked(s, d))


@query("SELECT cdc_event_id, quality_error FROM ch_marked WHERE quality_error <> ''", "ch_marked")
def cdc_quality_errors(s, d):
    return rules.quarantined(_cdc_marked(s, d)).select("cdc_event_id", "quality_error")


@query("SELECT * EXCLUDE (quality_error) FROM ch_marked WHERE quality_error = ''", "ch_marked")
def cdc_clean(s, d):
    return _walls(rules.valid(_cdc_marked(s, d)))


@query("SELECT * EXCLUDE (quality_error) FROM bills WHERE quality_error = ''", "bills")
def billing_silver(s, d):
    return _walls(rules.valid(_bills(s, d)))


@query("SELECT * FROM bills WHERE quality_error <> ''", "bills")
def billing_quarantine(s, d):
    return _walls(rules.quarantined(_bills(s, d)))


@query("SELECT count(*) AS source_rows, count(*) FILTER (quality_error = '') AS valid_rows, count(*) FILTER (quality_error <> '') AS quarantined_rows, true AS reconciled FROM bills", "bills")
def billing_reconciliation(s, d):
    return billing.reconcile(_bills(s, d))


# Customer history.


@query("SELECT * FROM dim", "dim")
def scd2_customer_dim(s, d):
    return _walls(_dimension(s, d))


@query("SELECT * FROM dim WHERE is_current", "dim")
def scd2_current(s, d):
    return _walls(cdc.current(_dimension(s, d)))


@query("SELECT customer_id, count(*) AS current_versions FROM dim WHERE is_current GROUP BY 1 HAVING count(*) > 1", "dim")
def scd2_violations(s, d):
    return cdc.current_violations(_dimension(s, d))


@query("SELECT operation, count(*) AS n FROM ch GROUP BY 1", "ch")
def cdc_ops_profile(s, d):
    return cdc.operations_profile(a.changes(s, d))


# Dedup.


@query("SELECT event_id, event_timestamp, meter_id, usage_value FROM readings", "readings")
def dedup_batch(s, d):
    return _walls(dedup.dedup_batch(a.with_repeats(a.readings(s, d))).select("event_id", "event_timestamp", "meter_id", "usage_value"))


@query(f"SELECT *, '2 days' AS watermark_delay FROM ({_DEDUP})", "readings")
def dedup_metrics(s, d):
    return _dedup_figures(s, d)


@query("SELECT event_id, 2::bigint AS copies FROM readings WHERE event_id::bigint % 50 = 0", "readings")
def duplicate_ids(s, d):
    return dedup.repeated_keys(a.with_repeats(a.readings(s, d)))


@query("SELECT count(*) FILTER (event_id::bigint % 50 = 0) AS repeats, 0::bigint AS dropped_late FROM readings", "readings")
def dedup_breakdown(s, d):
    source = a.with_repeats(a.readings(s, d).select("event_id"))
    return dedup.dedup_breakdown(source, dedup.dedup_batch(source))


def _streamed(s: SparkSession, root: str, name: str, df: DataFrame) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return s.readStream.schema(s.read.parquet(f"{root}/{name}").schema).parquet(f"{root}/{name}")


def _finished(s: SparkSession, stream: DataFrame, root: str, name: str) -> DataFrame:
    from ..sources.tables import append_available, read_table

    append_available(stream, f"{root}/{name}", f"{root}/checkpoint_{name}").awaitTermination()
    return read_table(s, f"{root}/{name}")


@query("SELECT event_id, event_timestamp, meter_id, usage_value FROM readings", "readings")
def dedup_stream(s, d):
    root = scratch(s)
    stream = _streamed(s, root, "source", a.with_repeats(a.readings(s, d)).select("event_id", "event_timestamp", "meter_id", "usage_value"))
    return _walls(_finished(s, dedup.dedup_stream(stream), root, "deduped"))


# Joins.


@query("SELECT * FROM zoned", "zoned")
def zone_join_batch(s, d):
    return _walls(_zoned(s, d))


@query("SELECT * FROM zoned", "zoned")
def zone_join_stream(s, d):
    root = scratch(s)
    stream = _streamed(s, root, "source", a.readings(s, d))
    return _walls(_finished(s, enrich.with_zones(stream, a.zones(s, d)), root, "zoned"))


@query("SELECT * FROM matches", "matches")
def outage_match_batch(s, d):
    return _walls(_matches(s, d))


@query("SELECT * FROM matches", "matches")
def outage_match_bucketed(s, d):
    return _walls(enrich.match_outages_bucketed(_zoned(s, d), a.outages(s, d)))


@query("SELECT * FROM matches", "matches")
def outage_match_stream(s, d):
    root = scratch(s)
    left, right = _streamed(s, root, "readings", _zoned(s, d)), _streamed(s, root, "outages", a.outages(s, d))
    return _walls(_finished(s, enrich.match_outages(left, right), root, "matches"))


@query(f"SELECT * FROM ({_DEDUP}) CROSS JOIN (SELECT count(*) AS outage_count FROM outages)", "readings", "outages")
def cross_join_metrics(s, d):
    return _dedup_figures(s, d).drop("watermark_delay").crossJoin(a.outages(s, d).agg(F.count(F.lit(1)).alias("outage_count")))  # one row each


# Bronze.


def _payloads(s: SparkSession, d: str) -> DataFrame:
    from ..sources.bronze import multiplex_rows
    from ..sources.registry import BY_ENTITY

    meters = a.raw_readings(s, d).withColumn("_source_file", F.lit("meters"))
    outages = a.outages(s, d).withColumns({"outage_event_timestamp": F.date_format("outage_event_timestamp", a.ISO), "resolved_timestamp": F.date_format("resolved_timestamp", a.ISO)})
    outages = outages.withColumnsRenamed({"outage_event_timestamp": "event_timestamp", "outage_event_type": "event_type", "outage_severity": "severity"}).withColumn("event_id", F.col("outage_id")).withColumn("_source_file", F.lit("outages"))
    return multiplex_rows(meters, BY_ENTITY["meter_readings"]).unionByName(multiplex_rows(outages, BY_ENTITY["outage_events"]))


@query("SELECT event_id, event_timestamp, meter_id, customer_id, service_zone_id, meter_type, usage_value, pressure_psi, battery_pct, meter_status FROM raw", "raw")
def multiplex_json_roundtrip(s, d):
    names = ["event_id", "event_timestamp", "meter_id", "customer_id", "service_zone_id", "meter_type", "usage_value", "pressure_psi", "battery_pct", "meter_status"]
    return _walls(quality.parse_meters(_payloads(s, d)).select(*names))


@query("SELECT outage_id, meter_id, outage_severity, estimated_duration_minutes, date_trunc('second', outage_event_timestamp) AS outage_event_timestamp, date_trunc('second', resolved_timestamp) AS resolved_timestamp FROM outages", "outages")
def multiplex_outages(s, d):
    return _walls(quality.parse_outages(_payloads(s, d)).select("outage_id", "meter_id", "outage_severity", "estimated_duration_minutes", "outage_event_timestamp", "resolved_timestamp"))


@query("SELECT 'meter_readings' AS source_entity, 'v1' AS schema_version, count(*) AS n FROM raw UNION ALL SELECT 'outage_events', 'v1', count(*) FROM outages", "raw", "outages")
def multiplex_counts(s, d):
    return _payloads(s, d).groupBy("source_entity", "schema_version").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'meter_readings' AS source_entity, coalesce(date_trunc('month', event_timestamp)::date::varchar, '__HIVE_DEFAULT_PARTITION__') AS folder, count(*) AS n FROM raw GROUP BY ALL", "raw")
def bronze_lineage(s, d):
    """Multiplexed rows by a stream over JSON files, by the folders of the files that they came from; every raw row is taken, dirty ones too."""
    from ..sources import bronze, registry, tables

    root, source = scratch(s), registry.BY_ENTITY["meter_readings"]
    days = a.raw_readings(s, d).withColumn("ingest_date", F.trunc(F.col("event_timestamp").try_cast("date"), "month"))  # null, a folder of its own, without a readable time
    days.write.partitionBy("ingest_date").json(f"{root}/raw/meter_readings")
    stream = bronze.multiplex_rows(registry.read_stream(s, source, f"{root}/raw"), source)
    tables.append_available(stream, f"{root}/bronze", f"{root}/checkpoint", source_entity=source.entity).awaitTermination()
    return tables.read_table(s, f"{root}/bronze").groupBy("source_entity", F.regexp_extract("_source_file", "ingest_date=([^/]+)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


# Change feed. Two versions of the dimension: without and with the changes from 1996 on.

_FEED = """old AS (SELECT customer_id, customer_name, segment, service_zone_id, account_status, et AS effective_start_timestamp, nt AS effective_end_timestamp, nt IS NULL AS is_current, nop = 'delete' AS closed_by_delete, sequence_num, cdc_event_id FROM (
    SELECT *, event_timestamp AS et, lead(event_timestamp) OVER w AS nt, lead(operation) OVER w AS nop FROM ch_marked WHERE quality_error = '' AND event_timestamp < TIMESTAMP '1996-01-01'
    WINDOW w AS (PARTITION BY customer_id ORDER BY sequence_num, event_timestamp, cdc_event_id)) WHERE operation <> 'delete'),
  gone AS (SELECT * FROM old EXCEPT SELECT * FROM dim), come AS (SELECT * FROM dim EXCEPT SELECT * FROM old),
  feed AS (SELECT g.*, CASE WHEN cdc_event_id IN (SELECT cdc_event_id FROM come) THEN 'update_preimage' ELSE 'delete' END AS _change_type, 1::bigint AS _commit_version FROM gone g
    UNION ALL SELECT c.*, CASE WHEN cdc_event_id IN (SELECT cdc_event_id FROM gone) THEN 'update_postimage' ELSE 'insert' END, 1::bigint FROM come c)"""


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    clean = rules.valid(_cdc_marked(s, d))
    return cdc.scd2(clean.where("event_timestamp < TIMESTAMP '1996-01-01'"), attributes=ATTRIBUTES), cdc.scd2(clean, attributes=ATTRIBUTES)


def _feed(s: SparkSession, d: str) -> DataFrame:
    return changefeed.changes(*_versions(s, d), version=1, at=F.current_timestamp(), key=("cdc_event_id",)).drop("_commit_timestamp")


@query("SELECT * FROM feed", "dim")
def change_feed_rows(s, d):
    return _walls(_feed(s, d))


@query("SELECT _commit_version, _change_type, count(*) AS n FROM feed GROUP BY 1, 2", "dim")
def change_feed_counts(s, d):
    return changefeed.feed_profile(_feed(s, d))


for _name in ("change_feed_rows", "change_feed_counts"):
    ORACLE[_name] = a.sql("§", "dim").replace(" §", f", {_FEED} " + ("SELECT * FROM feed" if _name.endswith("rows") else "SELECT _commit_version, _change_type, count(*) AS n FROM feed GROUP BY 1, 2"))


@query("SELECT *, 'insert' AS _change_type, 0::bigint AS _commit_version FROM dim", "dim")
def change_feed_first_version(s, d):
    return _walls(changefeed.first_version(_dimension(s, d), F.current_timestamp()).drop("_commit_timestamp"))


# Expressions, sorts, sets.


@query("SELECT 'readings' AS table_name, count(*) AS row_count FROM readings UNION ALL SELECT 'zones', count(*) FROM zones UNION ALL SELECT 'outages', count(*) FROM outages UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'dimension', count(*) FROM dim", "matches", "dim")
def union_counts(s, d):
    return gold.table_counts(readings=a.readings(s, d), zones=a.zones(s, d), outages=a.outages(s, d), matches=_matches(s, d), dimension=_dimension(s, d))


@query("SELECT event_id || '_r' || r AS event_id, event_timestamp + to_days((r % 365)::int) AS event_timestamp, r::int AS replica_id FROM readings CROSS JOIN range(3) t(r)", "readings")
def replicate_shift(s, d):
    source = a.readings(s, d).select("event_id", "event_timestamp")
    return _walls(benchdata.replicate(source, rows=3 * source.count()))


@query("SELECT event_id, sha256(event_id || ':' || 'a0') AS digest FROM readings", "readings")
def salted_payload(s, d):
    return a.readings(s, d).select("event_id", salted_digest("a0", F.col("event_id")).alias("digest"))


@query()
def scatter_buckets(s, d):
    return a.readings(s, d).groupBy(layout.scatter_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_timestamp, service_zone_id, usage_value FROM readings", "readings")
def cluster_layout_same_rows(s, d):
    root = scratch(s)
    layout.scatter(a.readings(s, d).select("event_id", "event_timestamp", "service_zone_id", "usage_value")).write.parquet(f"{root}/scattered")
    layout.optimize(s, f"{root}/scattered", f"{root}/clustered")
    return _walls(s.read.parquet(f"{root}/clustered"))


@query()
def layout_report(s, d):
    """Files and bytes of the scattered and the clustered layout."""
    root = scratch(s)
    layout.scatter(a.readings(s, d)).write.parquet(f"{root}/scattered")
    before, after = layout.describe(s, f"{root}/scattered"), layout.optimize(s, f"{root}/scattered", f"{root}/clustered")
    return before.withColumn("layout", F.lit("scattered")).unionByName(after.withColumn("layout", F.lit("clustered")))


@query("SELECT bill_id, customer_id, bill_amount_usd FROM bills WHERE quality_error = '' ORDER BY bill_amount_usd DESC, bill_id LIMIT 20", "bills")
def topk_billing(s, d):
    return rules.valid(_bills(s, d)).select("bill_id", "customer_id", "bill_amount_usd").orderBy(F.desc("bill_amount_usd"), "bill_id").limit(20)


@query("""SELECT * FROM (VALUES ('2024-01-02T03:04:05Z', TIMESTAMP '2024-01-02 03:04:05'), ('2024-01-02T03:04:05+07', TIMESTAMP '2024-01-01 20:04:05'), ('2024-01-02T03:04:05+07:00', NULL),
    ('2024-01-02T03:04:05.123Z', NULL), ('2024-01-02', NULL), ('not-a-timestamp', NULL)) t(text, parsed)""")
def ts_parse_cases(s, d):
    rows = [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+07",), ("2024-01-02T03:04:05+07:00",), ("2024-01-02T03:04:05.123Z",), ("2024-01-02",), ("not-a-timestamp",)]
    return _walls(s.createDataFrame(rows, "text string").withColumn("parsed", event_time(F.col("text"))))


@query("""SELECT * FROM (VALUES ('{"a": 1, "b": "x"}', 1, 'x'), ('{"b": "y", "c": 3}', NULL, 'y'), ('{', NULL, NULL), ('{}', NULL, NULL)) t(payload, a, b)""")
def json_parse_cases(s, d):
    rows = [('{"a": 1, "b": "x"}',), ('{"b": "y", "c": 3}',), ("{",), ("{}",)]
    return s.createDataFrame(rows, "payload string").withColumn("p", F.from_json("payload", "a int, b string")).select("payload", "p.a", "p.b")


@query(f"""SELECT service_zone_id, {TOTAL.format("(CASE WHEN meter_type = 'water' THEN usage_value ELSE 0.0::double END)")} AS water_usage,
    {TOTAL.format("(CASE WHEN meter_type = 'electric' THEN usage_value ELSE 0.0::double END)")} AS electric_usage FROM readings GROUP BY 1""", "readings")
def case_when_pivot(s, d):
    use = lambda kind: sum_if(F.col("meter_type") == kind, F.col("usage_value"))
    return a.readings(s, d).groupBy("service_zone_id").agg(use("water").alias("water_usage"), use("electric").alias("electric_usage"))


@query("SELECT customer_id, arg_max_null(payment_status, {'m': billing_month, 'b': bill_id}) AS latest_payment_status FROM bills WHERE customer_id IS NOT NULL AND billing_month IS NOT NULL GROUP BY 1", "bills")
def max_by_latest(s, d):
    return _bills(s, d).where("customer_id IS NOT NULL AND billing_month IS NOT NULL").groupBy("customer_id").agg(F.max_by("payment_status", F.struct("billing_month", "bill_id")).alias("latest_payment_status"))


@query("SELECT outage_id, date_sub('minute', outage_event_timestamp, resolved_timestamp) AS minutes FROM outages", "outages")
def timestampdiff_minutes(s, d):
    return a.outages(s, d).select("outage_id", F.timestamp_diff("MINUTE", "outage_event_timestamp", "resolved_timestamp").alias("minutes"))


@query("SELECT event_id, coalesce(pressure_psi, 0.0) AS pressure_psi FROM readings", "readings")
def coalesce_defaults(s, d):
    return a.readings(s, d).select("event_id", F.coalesce("pressure_psi", F.lit(0.0)).alias("pressure_psi"))


@query("SELECT service_zone_id, count(DISTINCT meter_id) AS meters FROM readings GROUP BY 1", "readings")
def count_distinct_by_zone(s, d):
    return a.readings(s, d).groupBy("service_zone_id").agg(F.count_distinct("meter_id").alias("meters"))


@query("SELECT service_zone_id, sum(CASE WHEN pressure_psi < 40 OR usage_value > 55 THEN 1 ELSE 0 END)::bigint AS suspicious FROM readings GROUP BY 1", "readings")
def conditional_sum(s, d):
    return a.readings(s, d).groupBy("service_zone_id").agg(count_if(gold.suspicious()).alias("suspicious"))


@query(f"SELECT meter_type, {TOTAL.format('usage_value')} AS total, {AVERAGE.format('usage_value')} AS average, count(*) AS n FROM readings GROUP BY 1", "readings")
def sums_and_averages(s, d):
    return a.readings(s, d).groupBy("meter_type").agg(exact_total(F.col("usage_value")).alias("total"), exact_average(F.col("usage_value")).alias("average"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, meter_type, row_number() OVER (ORDER BY meter_type DESC, event_id) AS place FROM readings ORDER BY meter_type DESC, event_id LIMIT 50", "readings")
def ordered_sample(s, d):
    """The first rows of a mixed order, a bounded top."""
    top = a.readings(s, d).select("event_id", "meter_type").orderBy(F.desc("meter_type"), "event_id").limit(50)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("meter_type"), "event_id")).cast("long"))  # over 50 rows


@query("SELECT * FROM readings WHERE 1 = 0", "readings")
def ctas_empty_clone(s, d):
    return _walls(layout.empty_clone(a.readings(s, d)))
