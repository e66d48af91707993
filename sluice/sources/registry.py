"""The raw sources and how they are read, as batches or as streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


@dataclass(frozen=True)
class Source:
    entity: str
    system: str
    form: str
    ddl: str
    partition: str | None = None
    header: bool = False

    @property
    def partition_column(self) -> str | None:
        return self.partition.split()[0] if self.partition else None


# Entities, systems and partition folders of the producers.
SOURCES = (
    Source("meter_readings", "ami_meter_gateway", "json", schemas.METER, "ingest_date date"),
    Source("outage_events", "outage_management", "json", schemas.OUTAGE, "ingest_date date"),
    Source("customer_cdc", "customer_crm", "json", schemas.CDC, "ingest_date date"),
    Source("billing", "billing_system", "json", schemas.BILLING, "billing_month date"),
    Source("gis_zones", "gis", "csv", schemas.ZONES, header=True),
)
BY_ENTITY = {s.entity: s for s in SOURCES}


def _reader(reader, source: Source, path: str) -> DataFrame:
    """The partition column comes from folder names; the schema leaves it out of the data, where some producers repeat it."""
    reader = reader.schema(schemas.struct(source.ddl, *([source.partition] if source.partition else [])))
    if source.header:
        reader = reader.option("header", True)
    df = reader.format(source.form).load(f"{path}/{source.entity}")
    return df.withColumn("_source_file", F.col("_metadata.file_path"))


def _rescuing(reader, source: Source, path: str) -> DataFrame:
    """Rows of JSON with what the schema doesn't know as text in _rescued_data: a producer's new keys, or the whole line where it is no JSON object. Null if there is none."""
    text = reader.schema(schemas.struct("value string", *([source.partition] if source.partition else []))).format("text").load(f"{path}/{source.entity}")
    known = schemas.struct(source.ddl)
    every = F.from_json("value", "map<string,string>")
    new = F.map_filter(every, lambda k, _: ~k.isin(*known.names, *filter(None, [source.partition_column])))
    rescued = F.when(every.isNull(), F.col("value")).when(F.size(new) > 0, F.to_json(new))
    parsed = text.withColumn("p", F.from_json("value", known)).withColumn("_rescued_data", rescued)
    return parsed.select("p.*", *filter(None, [source.partition_column]), "_rescued_data", F.col("_metadata.file_path").alias("_source_file"))


def read_batch(spark: SparkSession, source: Source, path: str, rescue: bool = False) -> DataFrame:
    return (_rescuing if rescue else _reader)(spark.read, source, path)


def read_stream(spark: SparkSession, source: Source, path: str, files: int | None = None, rescue: bool = False) -> DataFrame:
    """New files since the last run; files bounds those of one micro-batch."""
    reader = spark.readStream
    return (_rescuing if rescue else _reader)(reader.option("maxFilesPerTrigger", files) if files else reader, source, path)


def new_keys(rows: DataFrame) -> DataFrame:
    """The keys that producers send and the schema lacks, of rows read with rescue, and how many rows have them: what the next schema should take in."""
    keys = F.explode(F.map_keys(F.from_json("_rescued_data", "map<string,string>")))
    return rows.where("_rescued_data IS NOT NULL").select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows appended to a table's folder, with the schema it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
