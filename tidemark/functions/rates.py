"""Column expressions that queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0.0 where the whole is missing or not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where there is none."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def seconds(moment: Column) -> Column:
    """Whole seconds, cut off."""
    return moment.cast("timestamp").cast("long")


def hours_between(start: Column, end: Column) -> Column:
    return (seconds(end) - seconds(start)) / F.lit(3600)


def within(moment: Column, start: Column, end: Column) -> Column:
    """start <= moment < end."""
    return (moment >= start) & (moment < end)


def how_many(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("long")
