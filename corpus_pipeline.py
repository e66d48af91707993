"""A corpus in five stages: quality, exact copies, near copies, benchmark leaks, tokens."""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, exact_dedup, near, quality
from sluice.llm.common import aside, cut, lighten, scratch, shared_folder, table
from sluice.llm.queries import RANKS


def _chosen(docs: DataFrame, made: tuple[str, ...], stage, condition) -> DataFrame:
    """The rows of docs for which condition holds after stage, which makes columns of these names; docs' own of the same names come back as they were."""
    own, names = aside(docs, made)
    return stage(own).where(condition).select(*(F.col(names[c]).alias(c) if c in names else c for c in docs.columns))


def _light(stage):
    """stage, begun with executors' heaps collected: they hold on to what the stage before took, and here Python workers come on top."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lighten(spark)
        return stage(spark, docs, sf_dir)

    return run


@_light
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of those here."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _chosen(docs, quality.MADE, lambda own: quality.score(own, rules), "predicted = 1")


@_light
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _chosen(docs, exact_dedup.MADE, exact_dedup.exact_dedup, "kept")


@_light
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one of the least id (a null id last); rows are told apart by a number, so ids may be null or repeated."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    classes = near.jaccard_join(rows.select(key.alias("__key"), "text"), id_col="__key")
    dropped = classes.where("__key.row != class_id.row").select(F.col("__key.row").alias("__row"))
    return rows.join(dropped, "__row", "left_anti").select(*docs.columns)


@_light
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _chosen(docs, decontaminate.MADE, lambda own: decontaminate.find_leaks(own, table(spark, sf_dir, "benchmark")), F.size("leaks") == 0)


@_light
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of the ids and of what they decode to."""
    return bpe.digest(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=True).drop("text")


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("byte-level BPE", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again as the next one's input. A stage's input and checkpoints go once its output is written whole; the last output stays, as the result is read from it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
    return docs


#: SQL has neither the classifier's rules nor the tokenizer's merges; tests hold run() against plain versions.
ORACLE_SQL = None
