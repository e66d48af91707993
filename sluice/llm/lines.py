"""Line dedup: lines that occur on many sites are boilerplate and go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, aside, cut, drop

#: A line on this many distinct sites is boilerplate.
SITES = 10
#: Registers of a sketch as a power of two, and how many standard errors around the threshold count as near.
REGISTERS, ERRORS = 8, 4
#: Boilerplate lines up to this many are sent to every worker (some 100 bytes each); beyond, lines are joined by a shuffle.
BROADCAST = 200_000
#: Columns that dedup_lines adds.
MADE = ("kept_text", "n_lines", "n_removed")


#: White space that a blank line may hold.
BLANK = " \t\x0b\x0c\r"


def _key(line: Column | str) -> Column:
    """128 bits of a line's SHA-256: lines of equal keys are taken for equal."""
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def _lines(df: DataFrame, text: str, site: str) -> DataFrame:
    lines = df.select(F.explode(F.split(F.col(text), "\n")).alias("line"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"))
    return lines.where(F.translate("line", BLANK, "") != "").select(_key("line").alias("line"), "site")


def boilerplate(df: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """The 128-bit hashes of the lines that occur on sites distinct sites or more.

    One HyperLogLog sketch of sites for each line hash, merged by aggregation (partly on the map side, so a line that holds a third of all rows costs one sketch a task). Where the estimate is farther from the threshold than ERRORS standard errors it decides; the lines nearer than that are counted exactly. A null site is one site. Lines of white space alone are never boilerplate.
    """
    lines = _lines(df, text, site)
    margin = ERRORS * 1.04 / 2 ** (REGISTERS / 2)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", REGISTERS).alias("sketch"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    spread = cut(spread.select("line", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - margin)))
    near = spread.where(F.col("estimate") <= sites * (1 + margin)).select("line")
    far = spread.where(F.col("estimate") > sites * (1 + margin)).select("line")
    # Distinct first, on the map side too, so a hot line brings one row a site to the join.
    exact = lines.distinct().join(near, "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("line")
    found = cut(far.unionByName(exact))
    drop(spread)
    return found


def _without(gone, at: int, names: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = gone.value
        for batch in it:
            texts, total, removed = [], [], []
            for x in batch.column(at):
                text = x.as_py()
                lines = [] if text is None else text.split("\n")
                kept = [s for s in lines if hashlib.sha256(s.encode()).digest()[:16] not in drop]
                texts.append(None if text is None else "\n".join(kept))
                total.append(len(lines))
                removed.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "kept_text", "n_lines", "n_removed"])

    return run


def dedup_lines(df: DataFrame, text: str = "text", site: str = "source", sites: int = SITES, broadcast: int = BROADCAST) -> DataFrame:
    """df with kept_text (the text without its boilerplate lines, see boilerplate), n_lines and n_removed.

    Lines are what newlines separate, compared as they are; a null text has none and stays null, an empty text has one blank line. Repeated rows are each treated alike. Columns of df with these names are replaced; none may begin with two underscores.

    The set of boilerplate hashes is counted first. Up to broadcast of them go to the workers and documents are rewritten where they are read; more are joined by a shuffle of (row, place, hash), and the text then by its row.
    """
    df, names = aside(df, MADE)
    return _rewritten(df, names.get(text, text), names.get(site, site), sites, broadcast).drop(*names.values())


def _rewritten(df: DataFrame, text: str, site: str, sites: int, broadcast: int) -> DataFrame:
    gone = boilerplate(df, text, site, sites)
    spark = df.sparkSession
    if gone.count() <= broadcast:
        sent = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in gone.collect()))  # broadcast rows at most
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["kept_text string", "n_lines long", "n_removed long"])
        return arrow_map(df, _without(sent, df.columns.index(text), df.columns), schema)
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    lines = F.split(F.col(text), "\n")
    each = rows.select("__row", F.posexplode(lines).alias("__at", "__text")).select("__row", "__at", _key("__text").alias("line"))
    dropped = each.join(gone, "line", "left_semi").groupBy("__row").agg(F.collect_list("__at").alias("__gone"))
    joined = rows.join(dropped, "__row", "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__gone", i))
    return joined.select(*df.columns, F.array_join(kept, "\n").alias("kept_text"), F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"))
