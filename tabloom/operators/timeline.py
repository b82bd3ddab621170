"""Time roll-ups, growth and cohorts.

Windows here run over one row per day, month or year, never over raw rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cells import col, number, present
from ..functions.dates import day, day_name, month, months_between
from .joins import first_seen, lookup, share_of


def daily_trend(df: DataFrame, date_column: str, field: str, limit: int | None = None, *, latest: bool = False) -> DataFrame:
    """Rows and total per day: all days, or the earliest ``limit``, or the latest."""
    days = df.groupBy(day(col(date_column)).alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.round(F.sum(number(df, field)), 2).alias("daily_total")
    )
    ordered = days.orderBy(F.desc_nulls_last("day") if latest else F.asc_nulls_last("day"))
    return ordered if limit is None else ordered.limit(limit)


def monthly_totals(df: DataFrame, date_column: str, field: str, limit: int | None = None) -> DataFrame:
    """Rows and total per month, newest first."""
    at = day(col(date_column))
    months = (
        df.groupBy(F.year(at).cast("long").alias("year"), F.month(at).cast("long").alias("month"))
        .agg(F.count(F.lit(1)).alias("records"), F.round(F.sum(number(df, field)), 2).alias("monthly_total"))
        .orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("month"))
    )
    return months if limit is None else months.limit(limit)


def day_of_week(df: DataFrame, date_column: str, field: str) -> DataFrame:
    """Count, mean and total per weekday, Monday first."""
    at = day(col(date_column))
    value = number(df, field)
    return (
        df.groupBy(F.weekday(at).alias("__weekday"), day_name(at).alias("day_of_week"))
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.round(F.avg(value), 2).alias("daily_avg"),
            F.round(F.sum(value), 2).alias("total"),
        )
        .orderBy(F.asc_nulls_last("__weekday"))
        .drop("__weekday")
    )


def hourly(df: DataFrame, time_column: str, field: str) -> DataFrame:
    """Rows and total per hour of the day."""
    return (
        df.groupBy(F.hour(col(time_column).cast("timestamp_ntz")).cast("long").alias("hour"))
        .agg(F.count(F.lit(1)).alias("record_count"), F.round(F.sum(number(df, field)), 2).alias("hourly_total"))
        .orderBy(F.asc_nulls_last("hour"))
    )


def moving_average(df: DataFrame, date_column: str, field: str, rows: int = 7, limit: int | None = None) -> DataFrame:
    """Daily totals with the mean of the last ``rows`` days that have data, newest first."""
    days = df.groupBy(day(col(date_column)).alias("day")).agg(F.sum(number(df, field)).alias("__total"))
    frame = W.orderBy(F.asc_nulls_last("day")).rowsBetween(1 - rows, 0)
    result = days.select(
        "day",
        F.round("__total", 2).alias("daily_total"),
        F.round(F.avg("__total").over(frame), 2).alias("moving_avg_7d" if rows == 7 else f"moving_avg_{rows}d"),
    ).orderBy(F.desc_nulls_last("day"))
    return result if limit is None else result.limit(limit)


def month_over_month(df: DataFrame, date_column: str, field: str, limit: int | None = None) -> DataFrame:
    """Monthly totals against the previous month with data, newest first."""
    months = df.groupBy(month(col(date_column)).alias("month")).agg(F.sum(number(df, field)).alias("__total"))
    before = F.lag("__total").over(W.orderBy(F.asc_nulls_last("month")))
    result = months.select(
        "month",
        F.round("__total", 2).alias("current_month"),
        F.round(before, 2).alias("previous_month"),
        share_of(col("__total") - before, before).alias("growth_pct"),
    ).orderBy(F.desc_nulls_last("month"))
    return result if limit is None else result.limit(limit)


def year_over_year(df: DataFrame, date_column: str, field: str, limit: int | None = None) -> DataFrame:
    """Yearly totals against the previous year with data, newest first."""
    years = (
        df.where(present(df, date_column))
        .groupBy(F.year(day(col(date_column))).cast("long").alias("period"))
        .agg(F.sum(number(df, field)).alias("__total"))
    )
    before = F.lag("__total").over(W.orderBy(F.asc_nulls_last("period")))
    result = years.select(
        "period",
        F.round("__total", 2).alias("current_value"),
        F.round(before, 2).alias("previous_value"),
        share_of(col("__total") - before, before).alias("growth_pct"),
    ).orderBy(F.desc_nulls_last("period"))
    return result if limit is None else result.limit(limit)


def acquisition_cohorts(df: DataFrame, entity: str, date_column: str) -> DataFrame:
    """Entities by the month of their first activity (the NULL entity is not counted)."""
    firsts = first_seen(df, entity, date_column)
    return (
        firsts.groupBy(month(col("first_seen")).alias("cohort_month"))
        .agg(F.count(col(entity)).alias("new_users"))
        .orderBy("cohort_month")
    )


def retention(df: DataFrame, entity: str, date_column: str) -> DataFrame:
    """Active entities per cohort month and months since the first activity.

    Each entity is reduced to its set of active months, combined on the map side:
    one shuffle, and an entity with very many events is small before it.
    """
    active = (
        df.where(col(date_column).isNotNull() & col(entity).isNotNull())
        .groupBy(col(entity))
        .agg(F.collect_set(month(col(date_column))).alias("__months"))
        .select(F.array_min("__months").alias("cohort_month"), F.explode("__months").alias("__month"))
    )
    return (
        active.groupBy("cohort_month", months_between(col("cohort_month"), col("__month")).alias("month_index"))
        .agg(F.count(F.lit(1)).alias("active_users"))
        .orderBy("cohort_month", "month_index")
    )


def activity_with_first_seen(df: DataFrame, entity: str, date_column: str) -> DataFrame:
    """Each activity row with its entity's first activity; rows without entity or date drop out."""
    kept = df.where(col(date_column).isNotNull() & col(entity).isNotNull())
    joined = lookup(kept, first_seen(kept, entity, date_column, "acquisition_date"), [entity], "inner")
    return joined.select(*[col(c) for c in df.columns], "acquisition_date")
