"""Calendar expressions that agree with the reference semantics."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(c: Column) -> Column:
    return c.cast("date")


def month(c: Column) -> Column:
    return F.trunc(c.cast("date"), "month")


def day_name(c: Column) -> Column:
    """Full English day name."""
    return F.date_format(c.cast("date"), "EEEE")


def months_between(earlier: Column, later: Column) -> Column:
    """Number of month boundaries crossed (not whole months elapsed)."""
    first, last = earlier.cast("date"), later.cast("date")
    return ((F.year(last) * 12 + F.month(last)) - (F.year(first) * 12 + F.month(first))).cast("long")


def moment(c: Column) -> Column:
    """Timestamp, NULL where the text does not parse."""
    return c.try_cast("timestamp_ntz")


def date_features(c: Column) -> list[Column]:
    at = moment(c)
    return [
        F.year(at).cast("long").alias("year"),
        F.month(at).cast("long").alias("month"),
        F.date_format(at, "EEEE").alias("day_of_week"),
        (F.weekday(at) >= 5).alias("is_weekend"),
    ]
