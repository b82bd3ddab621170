"""Grouped and ungrouped aggregates of the table API and the analyses."""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import business_columns, col, is_numeric_type, number, present
from .joins import share_of, with_constants
from .quantiles import grouped_medians

_FUNCTIONS = {
    "SUM": F.sum,
    "AVG": F.avg,
    "MEAN": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "COUNT": F.count,
    "MEDIAN": F.median,
    "STDDEV": F.stddev_samp,
    "VARIANCE": F.var_samp,
}


def aggregate_function(name: str):
    """The Spark aggregate for a function name; a name that Spark does not know is rejected.

    Any aggregate of Spark may be named; one that is no aggregate fails when the query is analysed.
    """
    if name.upper() in _FUNCTIONS:
        return _FUNCTIONS[name.upper()]
    spark = SparkSession.getActiveSession()
    if not re.fullmatch(r"\w+", name) or spark is None or not spark.catalog.functionExists(name.lower()):
        raise ValueError(f"unsupported aggregate {name!r}: Spark has no such function")
    return lambda value: F.call_function(name.lower(), value)


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def aggregate(df: DataFrame, group_by: str | Sequence[str], field: str, func: str = "SUM") -> DataFrame:
    """Group, count and aggregate a field, skipping its NULL and blank cells; largest first."""
    groups = [col(c) for c in _names(group_by)]
    result = f"{func.lower()}_{field}"
    kept = df.where(present(df, field))
    if func.upper() == "MEDIAN":
        # The built-in keeps all distinct values of a group in one buffer.
        names = _names(group_by)
        medians = grouped_medians(kept, names, number(df, field), "__median")
        medians = medians.select(*[col(n).alias(f"__m{i}") for i, n in enumerate(names)], "__median")
        counts = kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
        same = [col(n).eqNullSafe(col(f"__m{i}")) for i, n in enumerate(names)]
        joined = counts.join(medians, reduce(lambda a, b: a & b, same), "left")
        rows = joined.select(*groups, "count", F.round("__median", 2).alias(result))
        return rows.orderBy(col(result).desc_nulls_last(), *[g.asc_nulls_last() for g in groups])
    return (
        kept.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(aggregate_function(func)(number(df, field)), 2).alias(result),
        )
        .orderBy(col(result).desc_nulls_last(), *[g.asc_nulls_last() for g in groups])
    )


def count_total_average(
    df: DataFrame,
    group_by: str | Sequence[str],
    field: str,
    *,
    count_name: str = "record_count",
    total_name: str = "total",
    average_name: str = "average",
) -> DataFrame:
    """Count, rounded sum and rounded mean per group, largest sum first."""
    groups = [col(c) for c in _names(group_by)]
    value = number(df, field)
    return (
        df.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias(count_name),
            F.round(F.sum(value), 2).alias(total_name),
            F.round(F.avg(value), 2).alias(average_name),
        )
        .orderBy(col(total_name).desc_nulls_last(), *[g.asc_nulls_last() for g in groups])
    )


def top_groups(
    df: DataFrame, group: str, field: str, limit: int = 5, *, exclude: Sequence[str] = (), total_name: str = "total"
) -> DataFrame:
    """The groups with the largest totals; ``exclude`` drops group names first (a NULL name too)."""
    kept = df.where(~col(group).isin(list(exclude))) if exclude else df
    return (
        kept.groupBy(col(group))
        .agg(F.sum(number(df, field)).alias(total_name))
        .orderBy(col(total_name).desc_nulls_last(), col(group).asc_nulls_last())
        .limit(limit)
    )


def share_of_total(df: DataFrame, group: str, field: str) -> DataFrame:
    """Total per group and its percentage of the grand total."""
    totals = df.groupBy(col(group)).agg(F.sum(number(df, field)).alias("total"))
    whole = totals.agg(F.sum("total").alias("__whole"))
    return (
        with_constants(totals, whole)
        .select(col(group), "total", share_of(col("total"), col("__whole")).alias("percentage"))
        .orderBy(col("total").desc_nulls_last(), col(group).asc_nulls_last())
    )


def value_counts(df: DataFrame, column: str, limit: int | None = None, *, value_name: str | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    counted = df.groupBy(col(column).alias(value_name or column)).agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.desc("count"), col(value_name or column).asc_nulls_last())
    return ordered if limit is None else ordered.limit(limit)


def top_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Most frequent non-blank values with their share of all non-blank rows."""
    kept = df.where(present(df, column))
    counts = kept.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count").alias("__whole"))
    result = (
        with_constants(counts, whole)
        .select("value", "count", share_of(col("count"), col("__whole")).alias("percentage"))
        .orderBy(F.desc("count"), F.asc_nulls_last("value"))
    )
    return result if limit is None else result.limit(limit)


def groups_having(df: DataFrame, group: str, field: str, min_rows: int) -> DataFrame:
    """Groups with at least ``min_rows`` rows, with count and mean."""
    return (
        df.groupBy(col(group))
        .agg(F.count(F.lit(1)).alias("count"), F.avg(number(df, field)).alias("average"))
        .where(col("count") >= min_rows)
        .orderBy(F.desc("count"), col(group).asc_nulls_last())
    )


def group_metrics(df: DataFrame, group: str, field: str) -> DataFrame:
    """Rows, sum, mean, max and share of positive values per non-NULL group."""
    value = number(df, field)
    positive = F.count_if(value > 0)
    return (
        df.where(col(group).isNotNull())
        .groupBy(col(group))
        .agg(
            F.count(F.lit(1)).alias("count_rows"),
            F.coalesce(F.sum(value), F.lit(0.0)).alias("sum_values"),
            F.avg(value).alias("mean_values"),
            F.max(value).alias("max_value"),
            (positive / F.count(F.lit(1)) * 100).alias("percent_positive"),
        )
        .orderBy(col(group))
    )


def group_summary(df: DataFrame, group: str, field: str, limit: int | None = None) -> DataFrame:
    """Sum, mean and count of the numeric cells per non-NULL group, largest sum first."""
    value = number(df, field)
    result = (
        df.where(col(group).isNotNull())
        .groupBy(col(group))
        .agg(
            F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
            F.avg(value).alias("average"),
            F.count(value).alias("count"),
        )
        .orderBy(F.desc("total"), col(group))
    )
    return result if limit is None else result.limit(limit)


def pivot_summary(df: DataFrame, index: str, field: str) -> DataFrame:
    """Sum, mean and count of one field per index value, with flattened names."""
    value = number(df, field)
    return (
        df.where(col(index).isNotNull())
        .groupBy(col(index))
        .agg(
            F.coalesce(F.sum(value), F.lit(0.0)).alias(f"sum_{field}"),
            F.avg(value).alias(f"mean_{field}"),
            F.count(value).alias(f"count_{field}"),
        )
        .orderBy(col(index))
    )


def funnel(df: DataFrame, entity: str, required: Sequence[str], second: Column, third: Column) -> DataFrame:
    """Three-step conversion counts and rates over rows where ``required`` columns are set.

    The third step is counted on its own, not within the second.
    """
    kept = df
    for name in required:
        kept = kept.where(col(name).isNotNull())
    known = col(entity).isNotNull()
    counts = kept.agg(
        F.count(F.lit(1)).alias("step_1_total_events"),
        F.count_if(known & second).alias("step_2_active_users"),
        F.count_if(known & third).alias("step_3_high_value"),
    )
    one, two, three = (col(c).cast("double") for c in counts.columns)
    return counts.select(
        "*",
        (F.try_divide(two, one) * 100).alias("step1_to_2_conv_rate"),
        (F.try_divide(three, two) * 100).alias("step2_to_3_conv_rate"),
    )


def chart_data(
    df: DataFrame,
    kind: str,
    x: str | None = None,
    y: str | None = None,
    *,
    color_by: str | None = None,
    facet_by: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Aggregate for a Bar or Line chart, or the rows for a Scatter, by ``x``; all of it unless a limit is given."""
    x = x or df.columns[0]
    if kind == "Scatter":
        return df if limit is None else df.orderBy(*[col(c).asc_nulls_last() for c in [x, *df.columns]]).limit(limit)
    if kind not in ("Bar", "Line"):
        raise ValueError("chart kind is Bar, Line or Scatter")
    y = y or next(iter(_numeric_columns(df)), None)
    groups = [x] + [c for c in (color_by, facet_by) if c and c in df.columns and c != "None"]
    measure = F.sum(number(df, y)) if y else F.count(F.lit(1))
    grouped = df.groupBy(*[col(g) for g in groups]).agg(measure.alias("y"))
    ties = [col(g).asc_nulls_last() for g in groups]
    order = [F.desc_nulls_last("y"), *ties] if kind == "Bar" else ties
    ordered = grouped.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def auto_chart(df: DataFrame, limit: int | None = None) -> tuple[str, DataFrame]:
    """Pick a chart kind from the column types and names, and aggregate for it."""
    names = business_columns(df)
    numeric = [c for c in _numeric_columns(df) if c in names]
    if not numeric:
        return "Bar", value_counts(df, names[0], limit, value_name="category")
    x = next((c for c in names if c not in numeric), names[0])
    grouped = df.groupBy(col(x).alias("x")).agg(F.sum(number(df, numeric[0])).alias("y"))
    if "date" in x.lower() or "time" in x.lower():
        return "Line", grouped.orderBy(F.asc_nulls_last("x"))
    ordered = grouped.orderBy(F.desc_nulls_last("y"), F.asc_nulls_last("x"))
    return "Bar", ordered if limit is None else ordered.limit(limit)


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric_type(f.dataType)]
