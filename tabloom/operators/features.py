"""Feature preparation: imputation, one-hot encoding, scaling, correlation."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import business_columns, col, is_numeric_type, number
from .joins import with_constants
from .quantiles import exact_quantiles_of


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in business_columns(df) if is_numeric_type(df.schema[c].dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in business_columns(df) if isinstance(df.schema[c].dataType, T.StringType)]


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The non-NULL cells of several text columns as (column, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value is not null")


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per text column, the smallest on ties.

    All columns are counted in one shuffle of (column, value) pairs combined on
    the map side, so no task holds all distinct values of a column.
    """
    if not columns:
        return {}
    counted = _cells(df, columns).groupBy("column", "value").count()
    best = counted.groupBy("column").agg(
        F.min_by("value", F.struct((-col("count")).alias("n"), col("value").alias("v"))).alias("mode")
    )
    return {r["column"]: r["mode"] for r in best.collect()}


def impute(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    text: Sequence[str] | None = None,
) -> DataFrame:
    """Fill numeric NULLs with the median and text NULLs with the mode ('Unknown' if there is none)."""
    numeric = numeric_columns(df) if numeric is None else list(numeric)
    text = text_columns(df) if text is None else list(text)
    fills: dict[str, Column] = {}
    medians = exact_quantiles_of(df, {c: number(df, c) for c in numeric}, (0.5,)) if numeric else {}
    for c in numeric:
        fills[c] = F.coalesce(number(df, c), F.lit(medians[c][0]).cast("double"))
    common = modes(df, text)
    for c in text:
        fills[c] = F.coalesce(col(c), F.lit(common.get(c, "Unknown")))
    return df.withColumns(fills) if fills else df


def low_cardinality(df: DataFrame, columns: Sequence[str], max_levels: int = 10) -> dict[str, list[str]]:
    """Sorted values of the text columns with fewer than ``max_levels`` of them.

    A pass of sketches rules out columns far above the limit, so the exact distinct
    values collected next are few.
    """
    if not columns:
        return {}
    rough = df.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if rough[f"c{i}"] < 4 * max_levels]
    found: dict[str, list[str]] = {c: [] for c in near}
    if near:
        for r in _cells(df, near).distinct().collect():
            found[r["column"]].append(r["value"])
    return {c: sorted(values) for c, values in found.items() if len(values) < max_levels}


def all_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted values of each column as text; they become column names, so they come to the driver."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        for r in _cells(df.select(*[col(c).cast("string").alias(c) for c in columns]), columns).distinct().collect():
            found[r["column"]].append(r["value"])
    return {c: sorted(values) for c, values in found.items()}


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, max_levels: int = 10) -> DataFrame:
    """0/1 columns per category value except the first.

    Every named column is encoded.  Without names, the text columns with fewer than ``max_levels`` values are;
    the others pass through unchanged.
    """
    chosen = low_cardinality(df, text_columns(df), max_levels) if columns is None else all_levels(df, list(columns))
    flags = [
        F.coalesce((col(c).cast("string") == F.lit(level)).cast("int"), F.lit(0)).alias(f"{c}_{level}")
        for c, values in chosen.items()
        for level in values[1:]
    ]
    return df.select(*[col(c) for c in df.columns if c not in chosen], *flags)


def scale(df: DataFrame, column: str) -> DataFrame:
    """Min-max and z-score versions of a column; NULL where the column is constant."""
    value = number(df, column)
    stats = df.agg(
        F.min(value).alias("__min"),
        F.max(value).alias("__max"),
        F.avg(value).alias("__mean"),
        F.stddev_samp(value).alias("__std"),
    )
    return (
        with_constants(df, stats)
        .withColumn(f"{column}_minmax", F.try_divide(value - col("__min"), col("__max") - col("__min")))
        .withColumn(f"{column}_standardized", F.try_divide(value - col("__mean"), col("__std")))
        .drop("__min", "__max", "__mean", "__std")
    )


#: Up to so many columns the sums of a correlation are plain aggregates; the results are the same.
FEW_COLUMNS = 6


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, over rows where both are set; NULL for a constant column."""
    names = numeric_columns(df) if columns is None else list(columns)
    schema = "column string, other string, correlation double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    r = _pearson(*_pair_sums(df, names))
    cells = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(cells, schema)


def _pearson(n: np.ndarray, x: np.ndarray, xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Pearson's r from the sums of each pair's rows; NaN where a column is constant over them."""
    with np.errstate(all="ignore"):
        one, two = xx - x * x / n, xx.T - x.T * x.T / n
        # Sums around the means leave rounding noise of a constant column, far below any spread.
        flat = ~(one > 1e-12 * xx) | ~(two > 1e-12 * xx.T)
        return np.where(flat, np.nan, (xy - x * x.T / n) / np.sqrt(one * two))


def _pair_sums(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, ...]:
    """For every pair of columns the rows where both are set, and over them the sums of the first, its squares and the products.

    All are blocks of one Gram matrix: a row is the vector of its values, their presence and their squares, absent
    ones 0, and the products of all pairs are summed by tree aggregation in the JVM.  The columns are shifted by their
    means first.  The result has a number per pair, whatever the rows.
    """
    values = [number(df, c) for c in names]
    there = [F.when(~F.isnan(v), v) for v in values]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(there)]).first()
    k = len(names)
    shifted = df.select(*[(v - F.lit(float(means[i] or 0.0))).cast("double").alias(f"v{i}") for i, v in enumerate(there)])
    cells = [col(f"v{i}") for i in range(len(names))]
    if k <= FEW_COLUMNS:
        # So few sums are one aggregate of generated code.
        both = [(i, j) for i in range(k) for j in range(k)]
        there = {(i, j): cells[i].isNotNull() & cells[j].isNotNull() for i, j in both}
        measures = {"n": lambda i, j: F.lit(1.0), "x": lambda i, j: cells[i], "xx": lambda i, j: cells[i] * cells[i], "xy": lambda i, j: cells[i] * cells[j]}
        sums = shifted.agg(*[F.sum(F.when(there[p], make(*p))).alias(f"{m}_{p[0]}_{p[1]}") for m, make in measures.items() for p in both]).first()
        return tuple(np.array([[sums[f"{m}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) for m in measures)
    zero = F.lit(0.0)
    parts = [F.coalesce(v, zero) for v in cells] + [v.isNotNull().cast("double") for v in cells] + [F.coalesce(v * v, zero) for v in cells]
    vectors = shifted.select(array_to_vector(F.array(*parts)).alias("row"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row"), 0, len(parts)).computeGramianMatrix().toArray()
    x, p, xx = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
    return gram[p, p], gram[x, p], gram[xx, p], gram[x, x]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The correlations as a square table, one row per column."""
    names = numeric_columns(df) if columns is None else list(columns)
    cells = [F.max(F.when(col("other") == n, col("correlation"))).alias(n) for n in names]
    return correlation(df, names).groupBy("column").agg(*cells)
