"""Bills: typed, checked, split and reconciled in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import billing_rules, parse_billing


def normalise(bronze: DataFrame) -> DataFrame:
    """Typed bills with quality_error."""
    return billing_rules().mark(parse_billing(bronze))


def reconcile(marked: DataFrame) -> DataFrame:
    """One row: source, valid and quarantined rows, and whether they add up."""
    bad = F.col("quality_error") != ""
    counted = marked.agg(F.count(F.lit(1)).alias("source_rows"), F.count(F.when(~bad, 1)).alias("valid_rows"), F.count(F.when(bad, 1)).alias("quarantined_rows"))
    return counted.withColumn("reconciled", F.col("source_rows") == F.col("valid_rows") + F.col("quarantined_rows"))
