"""Data-quality checks: duplicates, first row per key, outliers, freshness."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import ROW, business_columns, col, number, present
from .joins import lookup, share_of
from .ordered import Key
from .quantiles import exact_quantiles


#: The two halves of a row's digest.
_DIGEST = ("__d1", "__d2")


def _digest(df: DataFrame, names: Sequence[str]) -> tuple[list[Column], list[str]]:
    """A row's values as two hashes of 64 bits, and the columns that a hash cannot stand for.

    Hashing skips NULLs, so which cells are NULL is hashed with them.  Within nested values it skips them too, and it
    does not know collations; such columns stay as they are.
    """
    kinds = {n: df.select(col(n)).schema[0].dataType for n in names}
    plain = [n for n in names if isinstance(kinds[n], T.AtomicType) and (not isinstance(kinds[n], T.StringType) or kinds[n] == T.StringType())]
    cells = [*[col(n).isNull() for n in plain], *[col(n) for n in plain]]
    return [F.xxhash64(F.lit(seed), *cells).alias(d) for seed, d in enumerate(_DIGEST)], [n for n in names if n not in plain]


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each distinct row value (NULLs are values here).

    Rows are told apart by 128-bit digests, so that wide rows and long texts are not shuffled.
    """
    digest, rest = _digest(df, list(columns or business_columns(df)))
    groups = df.select(*digest, *[col(c) for c in rest]).groupBy(*_DIGEST, *[col(c) for c in rest]).agg(F.count(F.lit(1)).alias("__n"))
    totals = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("__groups"))
    extra = col("total_rows") - col("__groups")
    return totals.select(
        extra.alias("duplicate_count"), "total_rows", share_of(extra, col("total_rows")).alias("duplicate_pct")
    )


def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Row values that occur more than once, with their count.

    Only rows whose digest repeats are fetched and grouped by their values.
    """
    names = list(columns or business_columns(df))
    digest, _ = _digest(df, names)
    rows = df.select(*[col(c) for c in names], *digest)
    repeated = rows.groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    groups = (
        lookup(rows, repeated, _DIGEST, "inner")
        .groupBy(*[col(c) for c in names])
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
        .where("occurrence_count > 1")
    )
    if limit is None:
        return groups
    return groups.orderBy(F.desc("occurrence_count"), *[col(c).asc_nulls_last() for c in names]).limit(limit)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Key] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The first row of each key, or only some of its ``columns`` (less to shuffle).

    The minimum is combined on the map side, so a key that holds a large part of
    the rows is reduced before the shuffle.  The order must be total within a key;
    it defaults to the row lineage.
    """
    if order is None:
        if ROW not in df.columns:
            raise ValueError("name an order: the table has no row-lineage column")
        order = [Key(ROW)]
    kept = list(df.columns if columns is None else columns)
    rest = [c for c in kept if c not in keys]
    directions = {k.desc for k in order}
    if len(directions) != 1:
        raise ValueError("all order columns must share a direction")
    rank = F.struct(*[_sort_value(k, i) for k in order for i in (0, 1)])
    pick = F.max_by if directions.pop() else F.min_by
    if not rest:
        return df.select(*[col(c) for c in keys]).distinct()
    best = df.groupBy(*[col(c) for c in keys]).agg(pick(F.struct(*[col(c) for c in rest]), rank).alias("__row"))
    picked = best.select(*[col(c) for c in keys], *[F.col("__row").getField(c).alias(c) for c in rest])
    return picked.select(*[col(c) for c in kept])


def _sort_value(key: Key, part: int) -> Column:
    """Order parts that put NULL last: a NULL flag, then the value."""
    c = col(key.name)
    if part:
        return c.alias(f"v_{key.name}")
    return (c.isNotNull() if key.desc else c.isNull()).alias(f"n_{key.name}")


def outliers(df: DataFrame, field: str) -> DataFrame:
    """Count values outside Q1 - 1.5 IQR and Q3 + 1.5 IQR."""
    kept = df.where(present(df, field)).select(number(df, field).alias("v"))
    q1, median, q3 = exact_quantiles(kept, F.col("v"), (0.25, 0.5, 0.75))
    spread = None if q1 is None else q3 - q1
    low = F.lit(None if spread is None else q1 - 1.5 * spread).cast("double")
    high = F.lit(None if spread is None else q3 + 1.5 * spread).cast("double")
    return kept.agg(
        F.count(F.lit(1)).alias("total_values"),
        F.count_if(F.col("v") < low).alias("low_outliers"),
        F.count_if(F.col("v") > high).alias("high_outliers"),
        F.round(F.lit(median).cast("double"), 2).alias("median"),
        F.round(low, 2).alias("lower_bound"),
        F.round(high, 2).alias("upper_bound"),
    )


def freshness(df: DataFrame, date_column: str, as_of: str | None = None) -> DataFrame:
    """Earliest and latest value, and whole days from the latest to ``as_of`` (default today)."""
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    return df.agg(
        F.min(col(date_column)).alias("earliest_date"),
        F.max(col(date_column)).alias("latest_date"),
        F.datediff(today, F.max(col(date_column).cast("date"))).cast("long").alias("days_old"),
    )
