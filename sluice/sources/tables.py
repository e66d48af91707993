"""Sinks and maintenance of parquet tables without a transaction log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(df: DataFrame, path: str, batch_id: int, **fixed: str) -> None:
    """One micro-batch as its own folder, path/k=v/batch_id=n, overwritten when it is retried: several queries can share a table and nothing is lost or doubled."""
    folder = "/".join([path, *(f"{k}={v}" for k, v in fixed.items()), f"batch_id={batch_id}"])
    df.drop(*fixed).write.mode("overwrite").parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts a query that gives all that is new to each and then ends."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_available(stream: DataFrame, path: str, checkpoint: str, **fixed: str) -> StreamingQuery:
    """New rows appended to a table, exactly once. A batch is computed once, however stateful its plan, and an empty one leaves nothing."""

    def each(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            if not df.isEmpty():
                write_batch(df, path, batch_id, **fixed)
        finally:
            df.unpersist()

    return run_available(stream, checkpoint, each)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By path, so that files written a moment ago are seen."""
    df = spark.read.parquet(path)
    return df.drop("batch_id") if "batch_id" in df.columns else df


def overwrite(df: DataFrame, path: str) -> None:
    """Rows and schema replaced."""
    df.write.mode("overwrite").parquet(path)


class Snapshots:
    """Versions of a table under path/v=<n>, each with a manifest; readers see only versions whose manifest is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest="))

    def _claimed(self) -> int:
        """A version that no other writer has: the one who creates its claim file owns it."""
        root, fs = self._fs()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(root)
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        version = max((int(n.split("=")[1]) for n in names if n.startswith(("_claim=", "manifest="))), default=-1) + 1
        while not fs.createNewFile(path(f"{self.path}/_claim={version}")):
            version += 1
        return version

    def commit(self, df: DataFrame) -> int:
        """Writes df as the next version. Two writers at once get a version each; a writer that dies leaves a gap that nobody reads."""
        version = self._claimed()
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        rows = self.spark.read.parquet(f"{self.path}/v={version}").count()
        line = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("committed_at"), F.lit(rows).cast("long").alias("row_count"))
        line.write.mode("overwrite").parquet(f"{self.path}/manifest={version}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        versions = self.versions()
        version = max(versions) if version is None else version
        if version not in versions:
            raise ValueError(f"{self.path} has no version {version}")
        return self.spark.read.parquet(f"{self.path}/v={version}")

    def history(self) -> DataFrame:
        """version, committed_at and row_count of each version."""
        return self.spark.read.parquet(*(f"{self.path}/manifest={v}" for v in self.versions())).orderBy("version")

    def feed(self, version: int, key: tuple[str, ...] = ()) -> DataFrame:
        """The row changes that version brought."""
        from ..operators.changefeed import changes, first_version

        at = F.lit(self.history().where(F.col("version") == version).first()["committed_at"])
        before = max((v for v in self.versions() if v < version), default=None)
        if before is None:
            return first_version(self.read(version), at, version)
        return changes(self.read(before), self.read(version), version, at, key)

    def feed_stream(self, key: tuple[str, ...] = ()) -> DataFrame:
        """The feed as a stream: a first run reads the first version as inserts and then each version's changes, later runs what was committed since. A version's changes are written once, under feed/commit=<n>, when somebody first asks for them."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for version in self.versions():
            folder = f"{self.path}/feed/commit={version}"
            if not self._fs()[1].exists(jvm.Path(f"{folder}/_SUCCESS")):
                self.feed(version, key).write.mode("overwrite").parquet(folder)
        schema = self.spark.read.parquet(f"{self.path}/feed/commit={min(self.versions())}").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/feed/commit=*")


def create_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _text(value: str) -> str:
    """value as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def set_properties(spark: SparkSession, name: str, **properties: str) -> None:
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f'{_text(k)}={_text(v)}' for k, v in properties.items())})")


def property_of(spark: SparkSession, name: str, key: str) -> str:
    return spark.sql(f"SHOW TBLPROPERTIES {name} ({_text(key)})").first()["value"]


def tables_in(spark: SparkSession, namespace: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {namespace}")


def clone_empty(spark: SparkSession, name: str, of: str) -> None:
    """A table with the columns of another and no rows."""
    spark.sql(f"CREATE TABLE {name} USING PARQUET AS SELECT * FROM {of} WHERE 1 = 0")


def declare_clustering(spark: SparkSession, name: str, *columns: str) -> None:
    """Recorded with the table; operators.layout gives the physical effect."""
    spark.sql(f"ALTER TABLE {name} CLUSTER BY ({', '.join(columns)})")


def row_statistics(spark: SparkSession, name: str) -> int | None:
    """The row count that ANALYZE noted, None where there is none."""
    stats = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'").first()
    return int(stats["data_type"].split(", ")[1].split()[0]) if stats and "," in stats["data_type"] else None


def analyze(spark: SparkSession, name: str) -> None:
    """Column statistics for the planner; scans skip by the files' own."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
