"""Queries over sources, sinks, streaming state, table commands and views; importing this adds them to the catalog."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..generator import generate
from ..operators import benchdata, changefeed, dedup, gold, layout, quality
from ..sources import bronze, registry, tables
from ..streaming import jobs
from . import adapters as a
from .catalog import TOTAL, _cdc_marked, _finished, _streamed, _walls, _zoned, query, scratch
from .views import Views, report

METERS = ("event_id", "meter_id", "meter_type", "usage_value")


def _raw_json(s: SparkSession, d: str, root: str) -> registry.Source:
    """Raw readings as JSON files in folders by month, with a key that no schema knows in some rows."""
    raw = a.raw_readings(s, d).withColumn("ingest_date", F.trunc(F.col("event_timestamp").try_cast("date"), "month"))
    raw = raw.withColumn("leak_score", F.when(F.col("event_id").cast("long") % 10 == 0, F.lit(7)))
    raw.write.partitionBy("ingest_date").json(f"{root}/raw/meter_readings")
    return registry.BY_ENTITY["meter_readings"]


# Sources.


@query("SELECT event_id, meter_id, meter_type, usage_value, date_trunc('month', event_timestamp)::date AS ingest_date FROM raw", "raw")
def json_stream(s, d):
    """A stream over JSON files with a given schema and the column that their folders give."""
    root = scratch(s)
    stream = registry.read_stream(s, _raw_json(s, d, root), f"{root}/raw").select(*METERS, F.col("ingest_date"))
    return _finished(s, stream, root, "rows")


@query("SELECT event_id, meter_id, meter_type, usage_value FROM raw", "raw")
def json_batch(s, d):
    root = scratch(s)
    return registry.read_batch(s, _raw_json(s, d, root), f"{root}/raw").select(*METERS)


@query("SELECT zone_id, zone_name, zone_city AS city, pressure_band, service_priority, centroid_latitude, centroid_longitude FROM zones", "zones")
def csv_stream(s, d):
    root = scratch(s)
    a.zones(s, d).write.option("header", True).csv(f"{root}/raw/gis_zones")
    stream = registry.read_stream(s, registry.BY_ENTITY["gis_zones"], f"{root}/raw").drop("state", "_source_file")
    return _finished(s, stream, root, "zones")


@query("""SELECT event_id, '{"leak_score":"7"}' AS rescued FROM raw WHERE event_id::bigint % 10 = 0""", "raw")
def rescued_keys(s, d):
    """Rows with keys that the schema lacks, which are kept as text beside it."""
    root = scratch(s)
    rows = registry.read_batch(s, _raw_json(s, d, root), f"{root}/raw", rescue=True)
    return rows.where("_rescued_data IS NOT NULL").select("event_id", F.col("_rescued_data").alias("rescued"))


@query("SELECT 'leak_score' AS key, count(*) AS n FROM raw WHERE event_id::bigint % 10 = 0", "raw")
def schema_tracking(s, d):
    root = scratch(s)
    return registry.new_keys(registry.read_batch(s, _raw_json(s, d, root), f"{root}/raw", rescue=True))


@query("""SELECT * FROM (VALUES ('meter_readings', 'ami_meter_gateway', 'json', 'ingest_date'), ('outage_events', 'outage_management', 'json', 'ingest_date'),
    ('customer_cdc', 'customer_crm', 'json', 'ingest_date'), ('billing', 'billing_system', 'json', 'billing_month'), ('gis_zones', 'gis', 'csv', NULL)) t(entity, system, form, partition_column)""")
def source_registry(s, d):
    return s.createDataFrame([(x.entity, x.system, x.form, x.partition_column) for x in registry.SOURCES], "entity string, system string, form string, partition_column string")


@query("SELECT count(*) AS n, count(*) AS with_file, count(*) AS loaded_now, 'meter_readings' AS entity, 'ami_meter_gateway' AS system FROM raw", "raw")
def file_lineage(s, d):
    """Each Bronze row names its file, its source and when it was loaded."""
    root = scratch(s)
    source = _raw_json(s, d, root)
    stream = bronze.entity_rows(registry.read_stream(s, source, f"{root}/raw"), source)
    now = F.col("_load_date") == F.to_date("_ingestion_timestamp")
    rows = _finished(s, stream, root, "rows")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_source_file").contains("/meter_readings/ingest_date="), 1)).alias("with_file"), F.count(F.when(now, 1)).alias("loaded_now"),
        F.max("_source_entity").alias("entity"), F.max("_source_system").alias("system"),
    )


@query("SELECT event_id, meter_id, usage_value FROM readings", "readings")
def table_stream_scan(s, d):
    root = scratch(s)
    a.readings(s, d).select("event_id", "meter_id", "usage_value").write.parquet(f"{root}/table")
    return _finished(s, registry.table_stream(s, f"{root}/table"), root, "copy")


@query("SELECT range AS id, range * 2 AS twice FROM range(1000)")
def range_source(s, d):
    return s.range(1000).select("id", (F.col("id") * 2).alias("twice"))


@query("SELECT * FROM (VALUES ('billing', 25::bigint), ('customer_cdc', 20), ('gis_zones', 8), ('meter_readings', 200)) t(entity, n)")
def generated_sources(s, d):
    """The seeded generator's rows, of readings without repeats, duplicates off; its files are the driver's alone and go at once."""
    with tempfile.TemporaryDirectory() as folder:
        found = generate(folder, customers=25, meters=25, days=2, readings_per_day=4, duplicates=0.0, invalid=0.1, outages=0.1, seed=7)
    return s.createDataFrame([(k, n) for k, n in found.items() if k != "outage_events"], "entity string, n long")


# Sinks and streaming state.


@query("""SELECT 'silver' AS target, count(*) FILTER (quality_error = '') AS n FROM marked UNION ALL SELECT 'quarantine', count(*) FILTER (quality_error <> '') FROM marked
    UNION ALL SELECT 'metrics', 1 UNION ALL SELECT 'metrics total', count(*) FROM marked""", "marked")
def fan_out(s, d):
    """One stream to three tables."""
    root = scratch(s)
    raw = a.raw_readings(s, d).withColumn("raw_payload", F.to_json(F.struct("*"))).withColumn("event_timestamp", F.expr(f"try_to_timestamp(event_timestamp, \"{a.ISO[:-3]}X\")"))
    stream = quality.meter_rules().mark(_streamed(s, root, "raw", raw.coalesce(1)))
    jobs.enforce_quality(stream, root, "silver", "quarantine", "metrics", f"{root}/checkpoint").awaitTermination()
    counted = gold.table_counts(**{t: tables.read_table(s, f"{root}/{t}") for t in ("silver", "quarantine", "metrics")}).withColumnsRenamed({"table_name": "target", "row_count": "n"})
    total = tables.read_table(s, f"{root}/metrics").agg(F.sum("total_records").alias("n")).select(F.lit("metrics total").alias("target"), "n")
    return counted.unionByName(total)


@query("SELECT cdc_event_id, quality_error, quality_error = '' AS good FROM ch_marked", "ch_marked")
def two_queries(s, d):
    """Valid and quarantined rows by two streaming queries side by side."""
    root = scratch(s)
    stream = _streamed(s, root, "marked", _cdc_marked(s, d).select("cdc_event_id", "quality_error"))
    for q in jobs.split_streams(stream, root, "good", "bad", f"{root}/checkpoints"):
        q.awaitTermination()
    good = tables.read_table(s, f"{root}/good").withColumn("quality_error", F.lit("")).withColumn("good", F.lit(True))
    return good.select("cdc_event_id", "quality_error", "good").unionByName(tables.read_table(s, f"{root}/bad").select("cdc_event_id", "quality_error").withColumn("good", F.lit(False)))


@query("SELECT event_id, usage_value, meter_type FROM readings WHERE meter_type = 'water'", "readings")
def overwrite_sink(s, d):
    """Rows and schema of a table replaced."""
    root = scratch(s)
    tables.overwrite(a.readings(s, d).select("event_id"), f"{root}/t")
    tables.overwrite(a.readings(s, d).select("event_id", "usage_value", "meter_type").where("meter_type = 'water'"), f"{root}/t")
    return tables.read_table(s, f"{root}/t")


@query("SELECT event_id, usage_value FROM readings", "readings")
def checkpointed_runs(s, d):
    """Three runs of one stream: half of the rows, the rest, nothing new; each row arrives once."""
    root, rows = scratch(s), a.readings(s, d).select("event_id", "usage_value")
    for part in (0, 1, None):
        if part is not None:
            rows.where(F.col("event_id").cast("long") % 2 == part).write.mode("append").parquet(f"{root}/in")
        tables.append_available(registry.table_stream(s, f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return tables.read_table(s, f"{root}/out")


@query("SELECT 'meter_readings' AS source_entity, count(*) AS n FROM raw UNION ALL SELECT 'gis_zones', count(*) FROM zones", "raw", "zones")
def multiplex_streams(s, d):
    """Two sources by two streams into one table, partitioned by entity."""
    root = scratch(s)
    _raw_json(s, d, root)
    a.zones(s, d).write.option("header", True).csv(f"{root}/raw/gis_zones")
    jobs.ingest_multiplex(s, f"{root}/raw", root, f"{root}/checkpoints", (registry.BY_ENTITY["meter_readings"], registry.BY_ENTITY["gis_zones"]))
    return tables.read_table(s, f"{root}/bronze_raw_events").groupBy("source_entity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, usage_value FROM readings", "readings")
def retried_batch(s, d):
    """A micro-batch that is written twice under its number leaves its rows once."""
    root = scratch(s)
    for _ in range(2):
        tables.write_batch(a.readings(s, d).select("event_id", "usage_value"), f"{root}/t", 3)
    return tables.read_table(s, f"{root}/t")


@query("SELECT event_id FROM readings WHERE event_id::bigint % 2 = 0 UNION ALL SELECT 'newest'", "readings")
def late_rows(s, d):
    """Rows older than the watermark, which the newest row has moved on, are dropped by the next batch."""
    root = scratch(s)
    rows = a.readings(s, d).select("event_id", "event_timestamp")
    even = F.col("event_id").cast("long") % 2 == 0
    newest = rows.agg((F.max("event_timestamp") + F.expr("INTERVAL 400 DAYS")).alias("event_timestamp")).select(F.lit("newest").alias("event_id"), "event_timestamp")
    for part in (rows.where(even).unionByName(newest).coalesce(1), rows.where(~even).coalesce(1)):
        part.write.mode("append").parquet(f"{root}/in")
        tables.append_available(dedup.dedup_stream(registry.table_stream(s, f"{root}/in")), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return tables.read_table(s, f"{root}/out").select("event_id")


# Change feed by a stream.

_STEPS = """SELECT 0::bigint AS _commit_version, 'insert' AS _change_type, count(*) AS n FROM readings WHERE event_id::bigint % 3 <> 0
    UNION ALL SELECT 1, 'insert', count(*) FROM readings WHERE event_id::bigint % 3 = 0
    UNION ALL SELECT 1, 'delete', count(*) FROM readings WHERE event_id::bigint % 3 = 1
    UNION ALL SELECT 1, k, count(*) FROM readings, (VALUES ('update_preimage'), ('update_postimage')) t(k) WHERE event_id::bigint % 3 = 2 GROUP BY k"""


@query(_STEPS, "readings")
def change_feed_stream(s, d):
    """The first run of the stream takes the first version as inserts, the second only what was committed since."""
    root, rows = scratch(s), a.readings(s, d).select("event_id", "usage_value")
    kept = tables.Snapshots(s, f"{root}/table")
    third = F.col("event_id").cast("long") % 3
    for part in (rows.where(third != 0), rows.where(third != 1).withColumn("usage_value", F.when(third == 2, F.col("usage_value") + 1).otherwise(F.col("usage_value")))):
        kept.commit(part)
        tables.append_available(kept.feed_stream(("event_id",)), f"{root}/feed", f"{root}/checkpoint").awaitTermination()
    return changefeed.feed_profile(tables.read_table(s, f"{root}/feed"))


@query("SELECT 0::bigint AS version, count(*) FILTER (meter_type = 'water') AS row_count FROM readings UNION ALL SELECT 1, count(*) FROM readings", "readings")
def table_history(s, d):
    kept = tables.Snapshots(s, f"{scratch(s)}/table")
    kept.commit(a.readings(s, d).where("meter_type = 'water'"))
    kept.commit(a.readings(s, d))
    return kept.history().select("version", "row_count")


# Views and table commands.


@query(f"SELECT meter_type, count(*) AS n, {TOTAL.format('usage_value')} AS total FROM readings GROUP BY 1", "readings")
def materialized_view(s, d):
    """A view that is refreshed when its table has a new version."""
    from ..functions.expressions import exact_total

    root = scratch(s)
    kept, views, name = tables.Snapshots(s, f"{root}/table"), Views(s, f"{root}/views"), f"usage_{uuid.uuid4().hex}"
    kept.commit(a.readings(s, d).where("meter_type = 'water'"))
    views.define(name, lambda: kept.read().groupBy("meter_type").agg(F.count(F.lit(1)).alias("n"), exact_total(F.col("usage_value")).alias("total")), on=(kept,))
    views.update()
    kept.commit(a.readings(s, d))
    views.update()
    return s.table(name)


@query("SELECT service_zone_id, count(*) AS n FROM readings GROUP BY 1", "readings")
def temp_view(s, d):
    name = f"readings_{uuid.uuid4().hex}"
    a.readings(s, d).createOrReplaceTempView(name)
    return s.sql(f"SELECT service_zone_id, count(*) AS n FROM {name} GROUP BY service_zone_id")


@query("""SELECT * FROM (SELECT 'row count' AS what, count(*)::varchar AS value FROM readings UNION ALL SELECT * FROM (VALUES ('property', 'it''s "on"'), ('listed', 'clone,source'), ('listed after drop', 'source'), ('rows of clone', '0'), ('columns of clone', 'event_id,usage_value')))""", "readings")
def table_commands(s, d):
    """CREATE SCHEMA, ALTER TABLE with properties, SHOW, CREATE TABLE AS of nothing, ANALYZE, DROP."""
    root, name = scratch(s), f"trial_{uuid.uuid4().hex}"
    tables.create_namespace(s, name)
    try:
        a.readings(s, d).select("event_id", "usage_value").write.option("path", f"{root}/source").saveAsTable(f"{name}.source")
        tables.set_properties(s, f"{name}.source", enable_feed="it's \"on\"")
        tables.clone_empty(s, f"{name}.clone", f"{name}.source")
        tables.analyze(s, f"{name}.source")
        listed = lambda: ",".join(sorted(r["tableName"] for r in tables.tables_in(s, name).collect() if not r["isTemporary"]))
        clone = s.table(f"{name}.clone")
        found = [
            ("row count", str(tables.row_statistics(s, f"{name}.source"))), ("property", tables.property_of(s, f"{name}.source", "enable_feed")), ("listed", listed()),
            ("rows of clone", str(clone.count())), ("columns of clone", ",".join(clone.columns)),
        ]
        tables.drop_table(s, f"{name}.clone")
        found.append(("listed after drop", listed()))
    finally:
        s.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")
    return s.createDataFrame(found, "what string, value string")


@query("SELECT 'event_timestamp,service_zone_id' AS columns, count(*) AS n FROM readings", "readings")
def clustered_table(s, d):
    """CLUSTER BY, noted with the table."""
    name = f"trial_{uuid.uuid4().hex}"
    tables.create_namespace(s, name)
    try:
        s.sql(f"CREATE TABLE {name}.t (event_id STRING, service_zone_id STRING, event_timestamp TIMESTAMP) USING PARQUET CLUSTER BY (event_id) LOCATION '{scratch(s)}/t'")
        tables.declare_clustering(s, f"{name}.t", "service_zone_id", "event_timestamp")
        a.readings(s, d).select("event_id", "service_zone_id", "event_timestamp").write.insertInto(f"{name}.t")
        rows, noted = s.table(f"{name}.t").count(), {r["col_name"] for r in s.sql(f"DESCRIBE EXTENDED {name}.t").collect()} & {"service_zone_id", "event_timestamp"}
    finally:
        s.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")
    return s.createDataFrame([(",".join(sorted(noted)), rows)], "columns string, n long")


@query("SELECT * FROM (VALUES ('scattered', true, true), ('clustered', true, true)) t(layout, has_files, mean_agrees)")
def table_detail(s, d):
    """Files, bytes and mean size of a table before and after it was rewritten."""
    detail = _layouts(s, d)
    return detail.select("layout", (F.col("num_files") > 0).alias("has_files"), (F.abs(F.col("mean_file_bytes") * F.col("num_files") - F.col("size_in_bytes")) < 1).alias("mean_agrees"))


def _layouts(s: SparkSession, d: str) -> DataFrame:
    root = scratch(s)
    layout.scatter(a.readings(s, d)).write.parquet(f"{root}/scattered")
    before, after = layout.describe(s, f"{root}/scattered"), layout.optimize(s, f"{root}/scattered", f"{root}/clustered")
    return before.withColumn("layout", F.lit("scattered")).unionByName(after.withColumn("layout", F.lit("clustered")))


@query("SELECT event_id, service_zone_id, event_timestamp FROM readings WHERE service_zone_id = '7'", "readings")
def clustered_range_scan(s, d):
    """A filter on the clustering column over the rewritten table, in files of a bounded size."""
    root = scratch(s)
    a.readings(s, d).select("event_id", "service_zone_id", "event_timestamp").write.parquet(f"{root}/t")
    layout.optimize(s, f"{root}/t", f"{root}/clustered", target=64 << 10)
    return _walls(s.read.parquet(f"{root}/clustered").where("service_zone_id = '7'"))


# The rest.


@query("SELECT cdc_event_id, operation, sequence_num, customer_id, customer_name, segment, service_zone_id, account_status FROM ch", "ch")
def cdc_payloads(s, d):
    """Changes with a nested customer through JSON payloads and back."""
    names = ("customer_id", "customer_name", "segment", "service_zone_id", "account_status")
    rows = a.changes(s, d).select("cdc_event_id", "operation", "sequence_num", F.date_format("event_timestamp", a.ISO).alias("event_timestamp"), F.struct(*names).alias("customer"), F.lit("f").alias("_source_file"))
    parsed = quality.parse_cdc(bronze.multiplex_rows(rows, registry.BY_ENTITY["customer_cdc"]))
    return parsed.select("cdc_event_id", "operation", "sequence_num", *names)


@query("SELECT least(count(*), 100) AS n FROM readings", "readings")
def plain_limit(s, d):
    return a.readings(s, d).limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT true AS same_day, true AS now_is_later")
def current_times(s, d):
    now = F.current_timestamp()
    return s.range(1).select((F.current_date() == F.to_date(now)).alias("same_day"), (now > F.lit("2024-01-01").cast("timestamp")).alias("now_is_later"))


@query("SELECT count(*) AS n, true AS in_range, count(DISTINCT event_id) AS keys FROM readings", "readings")
def scatter_totals(s, d):
    """Hash buckets take every row, each key into one bucket within range."""
    rows = a.readings(s, d).select("event_id", layout.scatter_bucket().alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.min("bucket") >= 0).__and__(F.max("bucket") < layout.BUCKETS).alias("in_range"), F.count_distinct("event_id", "bucket").alias("keys"))


@query("SELECT 3 * count(*) + 7 AS n, 3 * count(*) + 7 AS keys, 3 AS last_replica FROM readings", "readings")
def replicate_exactly(s, d):
    """A benchmark table of a given number of rows."""
    source = a.readings(s, d).select("event_id", "event_timestamp")
    made = benchdata.replicate(source, rows=3 * source.count() + 7)
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("keys"), F.max("replica_id").alias("last_replica"))


@query("SELECT count(*) AS n, 128::bigint AS chars FROM readings", "readings")
def payload_columns(s, d):
    made = benchdata.with_payloads(a.readings(s, d).select("event_id"), payloads=2)
    return made.agg(F.count_distinct("payload_a", "payload_b").alias("n"), F.max(F.length("payload_a")).cast("long").alias("chars"))


@query("SELECT 'reports' AS what, true AS has_first, 6::bigint AS printed FROM readings LIMIT 1", "readings")
def printed_report(s, d):
    """The first row, and a table of two rows as text: a frame of three lines, the names and the rows."""
    rows = a.readings(s, d).select("event_id")
    text = report(rows.orderBy("event_id"), 2)
    lines = [x for x in text.splitlines() if x.startswith(("+", "|"))]
    return s.createDataFrame([("reports", rows.first() is not None, len(lines))], "what string, has_first boolean, printed long")


@query("SELECT count(*) AS matches, count(DISTINCT outage_id) AS outages FROM matches", "matches")
def match_job(s, d):
    """The streaming job that matches readings and outages."""
    root = scratch(s)
    left, right = _streamed(s, root, "readings", _zoned(s, d)), _streamed(s, root, "outages", a.outages(s, d))
    jobs.match(left, right, f"{root}/matches", f"{root}/checkpoint").awaitTermination()
    return tables.read_table(s, f"{root}/matches").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("outage_id").alias("outages"))
