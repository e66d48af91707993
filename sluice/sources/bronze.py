"""Raw rows to Bronze: a table for each entity, and one for all with the row as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Source

VERSION = "v1"


def entity_rows(raw: DataFrame, source: Source) -> DataFrame:
    """Source columns and lineage."""
    return raw.withColumns(
        {"_source_system": F.lit(source.system), "_source_entity": F.lit(source.entity), "_ingestion_timestamp": F.current_timestamp(), "_load_date": F.current_date()}
    )


def multiplex_rows(raw: DataFrame, source: Source) -> DataFrame:
    """Any entity as (source_entity, source_system, schema_version, raw_payload) and lineage. Null fields are left out of the payload."""
    fields = [c for c in raw.columns if c != "_source_file"]
    return raw.select(
        F.lit(source.entity).alias("source_entity"), F.lit(source.system).alias("source_system"), F.lit(VERSION).alias("schema_version"), F.to_json(F.struct(*fields)).alias("raw_payload"), "_source_file", F.current_timestamp().alias("_ingestion_timestamp"), F.current_date().alias("_load_date")
    )
