"""The streaming jobs: each catches up with all that is new and ends; started again, it goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import RuleSet, metrics, quarantined, valid
from ..operators.dedup import DELAY, dedup_stream
from ..operators.enrich import match_outages, with_zones
from ..sources.bronze import entity_rows, multiplex_rows
from ..sources.registry import SOURCES, Source, read_stream, table_stream
from ..sources.tables import append_available, run_available, write_batch


def ingest_entities(spark: SparkSession, raw: str, out: str, checkpoints: str, sources: tuple[Source, ...] = SOURCES) -> None:
    """A Bronze table for each source. All queries run side by side."""
    queries = [append_available(entity_rows(read_stream(spark, s, raw), s), f"{out}/bronze_{s.entity}", f"{checkpoints}/bronze_{s.entity}") for s in sources]
    for q in queries:
        q.awaitTermination()


def ingest_multiplex(spark: SparkSession, raw: str, out: str, checkpoints: str, sources: tuple[Source, ...] = SOURCES) -> None:
    """One Bronze table for all sources, partitioned by entity so that readers of one skip the others."""
    queries = [append_available(multiplex_rows(read_stream(spark, s, raw), s), f"{out}/bronze_raw_events", f"{checkpoints}/multiplex_{s.entity}", source_entity=s.entity) for s in sources]
    for q in queries:
        q.awaitTermination()


def enforce_quality(marked: DataFrame, out: str, good: str, bad: str, figures: str, checkpoint: str) -> StreamingQuery:
    """Valid rows, quarantined rows and a row of metrics from each micro-batch, which is computed once and written idempotently."""

    def each(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            if df.isEmpty():
                return
            write_batch(valid(df, "raw_payload"), f"{out}/{good}", batch_id)
            write_batch(quarantined(df), f"{out}/{bad}", batch_id)
            row = metrics(df).select(F.lit(batch_id).cast("long").alias("batch_id"), F.current_timestamp().alias("processed_at"), "*")
            write_batch(row, f"{out}/{figures}", batch_id)
        finally:
            df.unpersist()

    return run_available(marked, checkpoint, each)


def split_streams(marked: DataFrame, out: str, good: str, bad: str, checkpoints: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Valid and quarantined rows by two queries of their own, side by side."""
    return append_available(valid(marked), f"{out}/{good}", f"{checkpoints}/{good}"), append_available(quarantined(marked), f"{out}/{bad}", f"{checkpoints}/{bad}")


def mark(stream: DataFrame, rules: RuleSet) -> DataFrame:
    return rules.mark(stream)


def deduplicate(spark: SparkSession, source: str, out: str, checkpoint: str, delay: str = DELAY) -> StreamingQuery:
    return append_available(dedup_stream(table_stream(spark, source).drop("batch_id"), delay=delay), out, checkpoint)


def add_zones(spark: SparkSession, source: str, zones: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return append_available(with_zones(table_stream(spark, source).drop("batch_id"), zones), out, checkpoint)


def match(readings: DataFrame, outages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return append_available(match_outages(readings, outages), out, checkpoint)
