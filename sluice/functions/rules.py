"""Ordered validation rules that name all that is wrong with a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import count_if, percentage

SEPARATOR = "; "


@dataclass(frozen=True)
class Rule:
    """code is reported where broken is true; null isn't."""

    code: str
    broken: Column


def missing(column: str, code: str | None = None) -> Rule:
    return Rule(code or f"missing_{column}", F.col(column).isNull())


def not_in(column: str, allowed: tuple[str, ...], code: str) -> Rule:
    return Rule(code, F.col(column).isNull() | ~F.col(column).isin(*allowed))


def outside(column: str, code: str, low: float | None = None, high: float | None = None) -> Rule:
    """Null, under low or over high."""
    broken = F.col(column).isNull()
    if low is not None:
        broken = broken | (F.col(column) < low)
    if high is not None:
        broken = broken | (F.col(column) > high)
    return Rule(code, broken)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]

    def mark(self, df: DataFrame) -> DataFrame:
        """df with quality_error: the codes in the order of the rules, "" for a valid row. Works on batches and streams."""
        return df.withColumn("quality_error", F.concat_ws(SEPARATOR, *(F.when(r.broken, F.lit(r.code)) for r in self.rules)))

    @property
    def codes(self) -> list[str]:
        return [r.code for r in self.rules]


def valid(marked: DataFrame, *also_drop: str) -> DataFrame:
    return marked.where(F.col("quality_error") == "").drop("quality_error", *also_drop)


def quarantined(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("quality_error") != "")


def metrics(marked: DataFrame) -> DataFrame:
    """One row, also for no rows: total, valid and invalid records and the invalid share in percent (null of none)."""
    bad = F.col("quality_error") != ""
    counts = marked.agg(F.count(F.lit(1)).alias("total_records"), F.coalesce(count_if(~bad), F.lit(0)).cast("long").alias("valid_records"), F.coalesce(count_if(bad), F.lit(0)).cast("long").alias("invalid_records"))
    return counts.withColumn("invalid_rate_pct", percentage(F.col("invalid_records"), F.col("total_records")))


def error_profile(marked: DataFrame) -> DataFrame:
    """How often each code occurs."""
    return quarantined(marked).select(F.explode(F.split("quality_error", SEPARATOR)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
