"""Number expressions of the reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100·part/whole as double, null where the whole is 0."""
    return F.when(whole > 0, 100.0 * part / whole)


def share(part: Column, whole: Column) -> Column:
    """part/whole as double, null where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole)


def round_one_decimal(value: Column) -> Column:
    """One decimal, ties to even on the scaled value, as numeric arrays round."""
    return F.rint(value * 10) / 10


def two_decimals(value: Column) -> Column:
    """Display text with two decimals and no thousands separator."""
    return F.call_function("format_number", value, F.lit("0.00"))


def shade_bucket(pct: Column) -> Column:
    """Index of the 5-point band a percentage falls into."""
    return F.floor(pct / 5).cast("int")
