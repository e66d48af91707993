"""Exact dedup by content sort: range partitions of the normalised text, sorted, neighbours compared in full; hot groups salted.

Main path: DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, cut, partitions

#: The characters that normalisation deletes.
DROPPED = " \t\n\x0b\x0c\r"
#: Characters of a text by which it is dealt out and that its splitters hold.
HEAD = 32
#: Parts into which a hot group is salted, a power of two.
SALTS = 64
#: Columns that exact_dedup adds.
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), DROPPED, "")


def hot_prints(df: DataFrame, print_of: Column, share: int) -> DataFrame:
    """Fingerprints that hold more than 1 / (share * partitions) of all rows, with at least 64 rows: fewer than share * partitions of them."""
    counts = df.groupBy(print_of.alias("__print")).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 64")
    total = df.count()
    return cut(counts.where(F.col("__n") * share * partitions(df.sparkSession) > total).select("__print"))


def exact_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", share: int = 4) -> DataFrame:
    """df's rows and columns with keep_id, group_size, kept and text_sha256 (of the normalised text).

    Texts are equal when their normalised forms are equal byte for byte; null counts as empty, so null and blank texts are one group. Of each group the row with the most code points in the original text stays, then the one of the smallest id (a null id last; ids of any type that sorts); of fully repeated rows exactly one is kept. Columns of df with these names are replaced; none may begin with two underscores.

    Sampled splitters range-partition the normalised text by its first HEAD characters and then its fingerprint, so a sample of splitters is small however long texts are, and texts that only begin alike still spread. Each partition is sorted externally by these and the whole normalised text, and a window compares neighbours in full. A group of copies so large that it would fill a good part of a partition is found by its fingerprint's count beforehand and salted: its rows get one of SALTS numbers by which they are range-partitioned too, go through the same sort and comparisons, and each salt's best row and count, of which there are SALTS a group and fewer than share * partitions such groups, are merged and sent back to the rows.
    """
    df, names = aside(df, MADE)
    return _deduped(df, names.get(text, text), names.get(id_col, id_col), share).drop(*names.values())


def _deduped(df: DataFrame, text: str, id_col: str, share: int) -> DataFrame:
    norm = normalised(F.col(text))
    prints = hot_prints(df, F.xxhash64(norm), share)
    hot = not prints.isEmpty()
    rows = df.withColumn("__norm", norm).withColumn("__print", F.xxhash64("__norm")).withColumn("__len", F.coalesce(F.length(text), F.lit(0)))
    rows = rows.withColumn("__head", F.substring("__norm", 1, HEAD))
    by = ["__head", "__print"]  # no constant among them: the window would not see that rows are dealt out by its keys, and shuffle them again
    if hot:
        rows = rows.join(F.broadcast(prints.withColumn("__hot", F.lit(True))), "__print", "left")
        salt = F.when(F.col("__hot"), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
        rows, by = rows.withColumn("__salt", salt), [*by, "__salt"]
    dealt = rows.repartitionByRange(partitions(df.sparkSession), *by)
    same = Window.partitionBy(*by, "__norm").orderBy(F.col("__len").desc(), F.col(id_col).isNull(), F.col(id_col))
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {"keep_id": F.first(id_col).over(every), "group_size": F.count(F.lit(1)).over(every), "kept": F.row_number().over(same) == 1, "__longest": F.first("__len").over(every)}
    sorted_ = dealt.withColumns(made).withColumn("text_sha256", F.sha2(F.col("__norm"), 256))
    named = [F.col(c) for c in df.columns]
    if not hot:
        return sorted_.select(*named, *MADE)
    sorted_ = cut(sorted_.select(*named, *MADE, "__salt", "__longest"))
    best = F.min(F.struct((-F.col("__longest")).alias("less"), F.col("keep_id").isNull().alias("missing"), F.col("keep_id").alias("id"), F.col("__salt").alias("salt")))
    merged = sorted_.where("__salt > 0 AND kept").groupBy("text_sha256").agg(best.alias("__best"), F.sum("group_size").alias("__size"))
    whole = sorted_.where("__salt > 0").join(F.broadcast(cut(merged)), "text_sha256")  # one row a hot group
    whole = whole.select(*named, F.col("__best.id").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("kept") & (F.col("__salt") == F.col("__best.salt"))).alias("kept"), "text_sha256")
    return sorted_.where("__salt = 0").select(*named, *MADE).unionByName(whole)
