"""From raw files to matched outages by streams, twice, with a retry."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sluice.generator import generate
from sluice.operators import cdc, quality
from sluice.sources import tables
from sluice.sources.registry import BY_ENTITY, read_batch, table_stream
from sluice.streaming import jobs


def test_generator(tmp_path):
    counts = generate(str(tmp_path / "a"), customers=30, meters=30, days=2, readings_per_day=5, duplicates=0.2, invalid=0.2, outages=0.1, seed=11)
    again = generate(str(tmp_path / "b"), customers=30, meters=30, days=2, readings_per_day=5, duplicates=0.2, invalid=0.2, outages=0.1, seed=11)
    assert counts == again and counts["meter_readings"] > 300
    for f in sorted((tmp_path / "a").rglob("*.*")):
        assert f.read_bytes() == (tmp_path / "b" / f.relative_to(tmp_path / "a")).read_bytes()
    rows = [json.loads(x) for f in (tmp_path / "a").rglob("meter_readings/**/*.json") for x in f.read_text().splitlines()]
    assert any(r["is_intentionally_invalid"] for r in rows)
    assert len({r["event_id"] for r in rows}) < len(rows)
    changes = [json.loads(x) for f in (tmp_path / "a").rglob("customer_cdc/**/*.json") for x in f.read_text().splitlines()]
    assert "insert" in {c["operation"] for c in changes}


def test_pipeline(spark, tmp_path):
    raw, out, marks = str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "marks")
    counts = generate(raw, customers=40, meters=40, days=3, readings_per_day=6, duplicates=0.1, invalid=0.1, outages=0.2, seed=3)
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest_entities(spark, raw, out, marks)
        jobs.ingest_multiplex(spark, raw, out, marks)
    for entity, n in counts.items():
        assert tables.read_table(spark, f"{out}/bronze_{entity}").count() == n
        assert read_batch(spark, BY_ENTITY[entity], raw).count() == n
    multiplex = tables.read_table(spark, f"{out}/bronze_raw_events")
    assert {r["source_entity"]: r["n"] for r in multiplex.groupBy("source_entity").agg(F.count(F.lit(1)).alias("n")).collect()} == counts

    bronze = table_stream(spark, f"{out}/bronze_raw_events")
    marked = quality.meter_rules().mark(quality.parse_meters(bronze))
    jobs.enforce_quality(marked, out, "silver", "quarantine", "metrics", f"{marks}/quality").awaitTermination()
    good, bad = tables.read_table(spark, f"{out}/silver"), tables.read_table(spark, f"{out}/quarantine")
    assert good.count() + bad.count() == counts["meter_readings"] and bad.count() > 0
    assert tables.read_table(spark, f"{out}/metrics").agg(F.sum("total_records")).first()[0] == counts["meter_readings"]

    jobs.deduplicate(spark, f"{out}/silver", f"{out}/deduped", f"{marks}/dedup").awaitTermination()
    deduped = tables.read_table(spark, f"{out}/deduped")
    assert deduped.count() == good.select("event_id").distinct().count()

    zones = tables.read_table(spark, f"{out}/bronze_gis_zones")
    jobs.add_zones(spark, f"{out}/deduped", zones, f"{out}/zoned", f"{marks}/zoned").awaitTermination()
    zoned = tables.read_table(spark, f"{out}/zoned")
    assert zoned.count() == deduped.count() and zoned.where("zone_name IS NULL").isEmpty()

    outages = quality.parse_outages(bronze.where("source_entity = 'outage_events'"))
    jobs.match(table_stream(spark, f"{out}/zoned"), outages, f"{out}/matches", f"{marks}/matches").awaitTermination()
    from sluice.operators.enrich import match_outages

    batch = match_outages(zoned, quality.parse_outages(multiplex))
    assert tables.read_table(spark, f"{out}/matches").count() == batch.count() > 0

    for q in jobs.split_streams(quality.cdc_rules().mark(quality.parse_cdc(bronze)), out, "cdc_clean", "cdc_bad", marks):
        q.awaitTermination()
    dimension = cdc.scd2(tables.read_table(spark, f"{out}/cdc_clean"))
    assert dimension.count() > 0 and cdc.current_violations(dimension).isEmpty()


def test_late_and_repeated(spark, tmp_path):
    t0 = dt.datetime(2024, 5, 1)
    kind = "event_id string, event_timestamp timestamp"

    def run(n, *rows):
        spark.createDataFrame([(i, t0 + dt.timedelta(days=d)) for i, d in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.deduplicate(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
        return sorted(r.event_id for r in tables.read_table(spark, f"{tmp_path}/out").collect())

    assert run(0, ("a", 0), ("b", 0)) == ["a", "b"]
    assert run(1, ("a", 1), ("c", 10)) == ["a", "b", "c"]
    assert run(2, ("late", 1), ("d", 10)) == ["a", "b", "c", "d"]
    assert run(3, ("a", 11)) == ["a", "a", "b", "c", "d"]


def test_retried_batch(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        tables.write_batch(df, f"{tmp_path}/t", 4, source_entity="x")
    assert tables.read_table(spark, f"{tmp_path}/t").count() == 3


def test_snapshots(spark, tmp_path):
    kept = tables.Snapshots(spark, f"{tmp_path}/s")
    kind = "k int, v string"
    assert [kept.commit(spark.createDataFrame(rows, kind)) for rows in ([(1, "a")], [(1, "b"), (2, "c")])] == [0, 1]
    assert [r.row_count for r in kept.history().collect()] == [1, 2]
    assert sorted(r["_change_type"] for r in kept.feed(1, ("k",)).collect()) == ["insert", "update_postimage", "update_preimage"]
    assert [r["_change_type"] for r in kept.feed(0).collect()] == ["insert"]


def test_catalog_tables(spark, tmp_path):
    tables.create_namespace(spark, "trial")
    tables.drop_table(spark, "trial.t")
    tables.drop_table(spark, "trial.empty")
    spark.range(5).withColumn("z", F.lit("a")).write.mode("overwrite").option("path", f"{tmp_path}/t").saveAsTable("trial.t")
    tables.set_properties(spark, "trial.t", enable_feed="true")
    assert tables.property_of(spark, "trial.t", "enable_feed") == "true"
    tables.clone_empty(spark, "trial.empty", "trial.t")
    assert spark.table("trial.empty").count() == 0 and spark.table("trial.empty").columns == ["id", "z"]
    tables.analyze(spark, "trial.t")
    assert {r["tableName"] for r in tables.tables_in(spark, "trial").collect()} >= {"t", "empty"}
    tables.drop_table(spark, "trial.t")
    tables.drop_table(spark, "trial.empty")
