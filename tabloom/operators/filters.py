"""Row filters and derived columns of the analyses."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col, number, sort_rows, text_features, tier, value_band
from ..functions.dates import date_features, moment
from .quantiles import exact_quantiles


def add_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add or replace a derived text column; a replaced column moves to the end."""
    value = F.expr(expression).cast("string").alias(name)
    return df.select(*[col(c) for c in df.columns if c != name], value)


def median_of(df: DataFrame, field: str) -> float | None:
    return exact_quantiles(df, number(df, field), (0.5,))[0]


def at_least_median(df: DataFrame, field: str, default: int = 1000) -> DataFrame:
    """Rows whose value reaches the whole-number part of the median (``default`` if that is empty or zero)."""
    median = median_of(df, field)
    return df.where(number(df, field) >= F.lit(float(int(median) if median else default)))


def above_median(df: DataFrame, field: str, limit: int | None = None) -> DataFrame:
    """Rows strictly above the median; with a limit, those with the largest values."""
    value = number(df, field)
    kept = df.where(value > F.lit(median_of(df, field)).cast("double"))
    return kept if limit is None else kept.orderBy(value.desc(), *[col(c) for c in df.columns]).limit(limit)


def median_bands(df: DataFrame, field: str) -> DataFrame:
    """How many rows are missing, zero, below or above (or at) the median."""
    median = F.lit(median_of(df, field)).cast("double")
    value = number(df, field)
    band = (
        F.when(value.isNull(), "Missing")
        .when(value == 0, "Zero")
        .when(value < median, "Below Median")
        .otherwise("Above Median")
    )
    return (
        df.select(band.alias("category")).groupBy("category").count().orderBy(F.desc("count"), "category")
    )


def tiers(df: DataFrame, field: str, name: str = "tier") -> DataFrame:
    return df.withColumn(name, tier(number(df, field)))


def value_tiers(df: DataFrame, field: str, name: str = "value_tier") -> DataFrame:
    return df.withColumn(name, value_band(number(df, field)))


def status_and_amount(df: DataFrame, status: str | None, field: str, wanted: str = "active", at_least: float = 500) -> DataFrame:
    """Rows at or above an amount, of one status if a status column is given."""
    kept = df.where(number(df, field) >= at_least)
    return kept.where(col(status) == wanted) if status else kept


def high_values(df: DataFrame, field: str, above: float = 10_000) -> DataFrame:
    return sort_rows(df.where(number(df, field) > above), col(field).desc_nulls_last())


def with_date_features(df: DataFrame, date_column: str) -> DataFrame:
    """Year, month, day name and weekend flag; rows whose date does not parse are dropped."""
    return df.where(moment(col(date_column)).isNotNull()).select("*", *date_features(col(date_column)))


def with_text_features(df: DataFrame, column: str) -> DataFrame:
    return df.select("*", *text_features(column))


def with_number(df: DataFrame, column: str) -> DataFrame:
    """Replace a column by its numeric reading, NULL where it has none."""
    return df.withColumn(column, number(df, column))
