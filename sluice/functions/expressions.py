"""Column expressions that several operators share. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The only accepted form of event times: an offset of hours or Z, no fractions.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"


def event_time(text: Column) -> Column:
    """Text to an instant; null if it isn't of TIME_FORMAT."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def exact_sum(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows: each value to twelve decimals, added as decimals of up to 26 whole digits. A value beyond that makes the sum one of doubles."""
    wide = value.cast("double").try_cast("decimal(38,12)")
    return F.when(F.count(value) == F.count(wide), F.try_sum(wide).cast("double")).otherwise(F.sum(value.cast("double")))


def rounded(value: Column, places: int = 2) -> Column:
    """A double rounded half up on its decimal form to ten places, as a double."""
    return F.round(value.cast("decimal(38,10)"), places).cast("double")


def exact_average(value: Column) -> Column:
    return rounded(exact_sum(value) / F.count(value))


def exact_total(value: Column) -> Column:
    return rounded(exact_sum(value))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places, null if whole is 0."""
    return rounded(F.lit(100.0) * part.cast("double") / F.when(whole != 0, whole.cast("double")))


def count_if(condition: Column) -> Column:
    """How many rows meet condition; null is no."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def sum_if(condition: Column, value: Column) -> Column:
    """The sum of value where condition holds, 0 elsewhere."""
    return exact_total(F.when(condition, value).otherwise(F.lit(0.0)))


def salted_digest(salt: str, *columns: Column) -> Column:
    """Hex sha256 of the columns and a salt: text that doesn't compress."""
    return F.sha2(F.concat_ws(":", *columns, F.lit(salt)), 256)


def wall_time(instant: Column) -> Column:
    """An instant as the session's wall-clock time."""
    return instant.cast("timestamp_ntz")
