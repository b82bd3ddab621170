"""Pivots and cross-tabulations.

Wide results need one column per distinct value, so the values come to the
driver; a caller may bound them with ``max_levels``.  The long forms need no
column per value.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col, number
from ..staging import stage
from .aggregate import aggregate_function
from .quantiles import grouped_medians


def levels(df: DataFrame, column: str, max_levels: int | None = None) -> list:
    """Sorted distinct non-NULL values of a column; more than the caller's bound are an error."""
    distinct = df.select(col(column).alias("level")).where("level is not null").distinct()
    found = (distinct if max_levels is None else distinct.limit(max_levels + 1)).collect()
    if max_levels is not None and len(found) > max_levels:
        raise ValueError(f"{column!r} has more than {max_levels} distinct values; use the long form")
    return sorted(r["level"] for r in found)


def pivot(
    df: DataFrame, row_key: str, col_key: str, value: str, func: str = "SUM", *, max_levels: int | None = None
) -> DataFrame:
    """One row per ``row_key``, one column per value of ``col_key``."""
    if func.upper() == "MEDIAN":
        # Medians of the cells first: the built-in keeps all distinct values of a cell in one buffer.
        found = stage(grouped_medians(df, [row_key, col_key], number(df, value), "__median"), "pivot-medians")
        cells = [
            F.round(F.max(F.when(col(col_key) == F.lit(level), col("__median"))), 2).alias(str(level))
            for level in levels(df, col_key, max_levels)
        ]
        rows = df.select(col(row_key)).distinct().select(col(row_key), F.lit(None).cast(df.schema[col_key].dataType).alias(col_key), F.lit(None).cast("double").alias("__median"))
        return found.unionByName(rows).groupBy(col(row_key)).agg(*cells).orderBy(col(row_key).asc_nulls_last()) if cells else rows.select(row_key)
    apply = aggregate_function(func)
    cells = [
        F.round(apply(F.when(col(col_key) == F.lit(level), number(df, value))), 2).alias(str(level))
        for level in levels(df, col_key, max_levels)
    ]
    rows = df.groupBy(col(row_key)).agg(*cells) if cells else df.select(col(row_key)).distinct()
    return rows.orderBy(col(row_key).asc_nulls_last())


def pivot_long(df: DataFrame, row_key: str, col_key: str, value: str, func: str = "SUM") -> DataFrame:
    """The pivot's filled cells as rows; no limit on distinct values."""
    if func.upper() == "MEDIAN":
        kept = df.where(col(col_key).isNotNull())
        keys = kept.groupBy(col(row_key), col(col_key)).agg(F.lit(None).cast("double").alias("__median"))
        found = grouped_medians(kept, [row_key, col_key], number(df, value), "__median").unionByName(keys)
        cells = found.groupBy(col(row_key), col(col_key)).agg(F.round(F.max("__median"), 2).alias("value"))
        return cells.orderBy(col(row_key).asc_nulls_last(), col(col_key).asc_nulls_last())
    return (
        df.where(col(col_key).isNotNull())
        .groupBy(col(row_key), col(col_key))
        .agg(F.round(aggregate_function(func)(number(df, value)), 2).alias("value"))
        .orderBy(col(row_key).asc_nulls_last(), col(col_key).asc_nulls_last())
    )


def crosstab_percent(df: DataFrame, rows: str, columns: str, *, max_levels: int | None = None) -> DataFrame:
    """Share of each column value within a row value, in percent."""
    kept = df.where(col(rows).isNotNull() & col(columns).isNotNull())
    counts = stage(
        kept.groupBy(col(rows), col(columns).alias("__c")).agg(F.count(F.lit(1)).alias("__n")), "crosstab"
    )
    cells = [
        (F.sum(F.when(col("__c") == F.lit(level), col("__n")).otherwise(0)) / F.sum("__n") * 100).alias(str(level))
        for level in levels(counts, "__c", max_levels)
    ]
    return counts.groupBy(col(rows)).agg(*cells).orderBy(col(rows))


def crosstab_margins(
    df: DataFrame, rows: str, columns: str, *, total: str = "TOTAL", max_levels: int | None = None
) -> DataFrame:
    """Counts per pair of values with a total column and a total row (last)."""
    kept = df.where(col(rows).isNotNull() & col(columns).isNotNull())
    # Staged: the counts give both the levels and the cells, so the input is read once.
    counts = stage(
        kept.groupBy(col(rows).cast("string").alias(rows), col(columns).alias("__c")).agg(F.count(F.lit(1)).alias("__n")),
        "crosstab",
    )
    found = levels(counts, "__c", max_levels)
    cells = [
        F.coalesce(F.sum(F.when(col("__c") == F.lit(level), col("__n"))), F.lit(0)).alias(str(level))
        for level in found
    ]
    cells.append(F.coalesce(F.sum("__n"), F.lit(0)).alias(total))
    return (
        counts.rollup(col(rows))
        .agg(*cells, F.grouping(col(rows)).alias("__total"))
        .withColumn(rows, F.when(col("__total") == 1, F.lit(total)).otherwise(col(rows)))
        .orderBy("__total", col(rows))
        .drop("__total")
    )


def crosstab_long(df: DataFrame, rows: str, columns: str, *, total: str = "TOTAL") -> DataFrame:
    """Counts with margins as (row, column, count); no limit on distinct values."""
    kept = df.where(col(rows).isNotNull() & col(columns).isNotNull())
    cube = kept.select(col(rows).cast("string").alias("row"), col(columns).cast("string").alias("column")).cube(
        "row", "column"
    )
    return cube.agg(
        F.count(F.lit(1)).alias("count"), F.grouping("row").alias("__r"), F.grouping("column").alias("__c")
    ).select(
        F.when(col("__r") == 1, F.lit(total)).otherwise(col("row")).alias("row"),
        F.when(col("__c") == 1, F.lit(total)).otherwise(col("column")).alias("column"),
        "count",
    )
