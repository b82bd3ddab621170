"""Column profiles: each profile is one aggregate over all columns, then unpivoted."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import ROW, business_columns, col, is_numeric_type, looks_numeric, number, present
from .quantiles import exact_quantiles_of

# Columns per aggregate; wider tables are profiled in several aggregates.
COLUMNS_PER_PASS = 200
#: Size of a rank sketch, in items of its largest level.
RANK_SKETCH = 1024
#: Standard errors of a distinct count of the session's default sketch, by which it may be held to miss.
DISTINCT_ERROR = 0.05


def rank_error(sketch: int = RANK_SKETCH) -> float:
    """How far, as a share of all ranks, a quantile of a rank sketch of this size lies off: in 99 of 100 sketches no further."""
    return 2.296 / sketch**0.9021


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, callable]) -> DataFrame:
    """One row per column with the given measures, computed in a single pass per batch."""
    batches = [columns[i : i + COLUMNS_PER_PASS] for i in range(0, len(columns), COLUMNS_PER_PASS)]
    result: DataFrame | None = None
    for start, batch in enumerate(batches):
        aggs = [
            make(name).alias(f"{measure}_{i}") for i, name in enumerate(batch) for measure, make in measures.items()
        ]
        entries = [
            F.struct(
                F.lit(start * COLUMNS_PER_PASS + i).alias("position"),
                F.lit(name).alias("column"),
                *[F.col(f"{measure}_{i}").alias(measure) for measure in measures],
            )
            for i, name in enumerate(batch)
        ]
        part = df.agg(*aggs).select(F.inline(F.array(*entries)))
        result = part if result is None else result.unionByName(part)
    return result


def schema_table(df: DataFrame) -> DataFrame:
    """Column names and types."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def coverage(df: DataFrame) -> DataFrame:
    """Non-blank cells per business column, as count and percentage of all rows."""
    result = _per_column(
        df,
        business_columns(df),
        {"present": lambda c: F.count_if(present(df, c)), "total": lambda c: F.count(F.lit(1))},
    )
    share = F.coalesce(F.try_divide(col("present").cast("double"), col("total")) * 100, F.lit(0.0))
    return result.select("column", "present", F.round(share, 1).alias("coverage_%"))


def low_coverage(df: DataFrame, below: float = 90.0) -> DataFrame:
    return coverage(df).where(col("coverage_%") < below)


def missing_counts(df: DataFrame) -> DataFrame:
    """NULL cells per column, columns without any left out."""
    result = _per_column(df, list(df.columns), {"missing_count": lambda c: F.count_if(col(c).isNull())})
    return result.where("missing_count > 0").select("column", "missing_count")


def numeric_patterns(df: DataFrame, first: int | None = None) -> DataFrame:
    """Cells that look like plain numbers, and blank cells, per column (or of the ``first`` columns)."""
    names = business_columns(df)[:first] if first else business_columns(df)
    result = _per_column(
        df,
        names,
        {
            "total": lambda c: F.count(F.lit(1)),
            "numeric_count": lambda c: F.count_if(looks_numeric(col(c))),
            "empty_count": lambda c: F.count_if(col(c).cast("string") == ""),
        },
    )
    return result.select(
        "column", "total", "numeric_count", "empty_count", (col("numeric_count") == col("total")).alias("is_numeric")
    )


def _as_text(df: DataFrame, name: str) -> Column:
    return col(name).cast("string")


def summarize(df: DataFrame, *, exact_percentiles: bool = False, sketch: int = RANK_SKETCH) -> DataFrame:
    """Type, count, min, max, mean, deviation, quartiles, NULL share and distinct estimate per column.

    Statistics of text columns are shown only where min or max parse as a number.  Quartiles come from mergeable
    rank sketches of bounded size, one for each column, within ``rank_error(sketch)`` of the wanted rank, unless
    ``exact_percentiles`` is set (a few more passes for all columns together).
    """
    numeric = {f.name for f in df.schema if is_numeric_type(f.dataType)}

    def rounded(value: Column) -> Column:
        return F.round(value.cast("double"), 2)

    def edge(c: str, pick) -> Column:
        kind = df.schema[c].dataType
        if c in numeric:
            return rounded(pick(col(c)))
        if isinstance(kind, T.StringType):
            return F.round(pick(col(c)).try_cast("double"), 2)
        return F.lit(None).cast("double")

    def stat(c: str, pick) -> Column:
        return rounded(pick(number(df, c))) if c in numeric else F.lit(None).cast("double")

    def quartiles(c: str) -> Column:
        if c in numeric:
            value = number(df, c)
            ranks = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
            return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.when(~F.isnan(value), value), sketch), ranks)
        return F.lit(None).cast("array<double>")

    measures = {
        "type": lambda c: F.lit(df.schema[c].dataType.simpleString()),
        "count": lambda c: F.count(F.lit(1)),
        "min": lambda c: edge(c, F.min),
        "max": lambda c: edge(c, F.max),
        "avg": lambda c: stat(c, F.avg),
        "std": lambda c: stat(c, F.stddev_samp),
    }
    if not exact_percentiles:
        # One sketch per column serves all three.
        measures["quartiles"] = quartiles
    measures |= {
        "null_percentage": lambda c: F.round(
            F.coalesce(F.try_divide(F.count_if(col(c).isNull()).cast("double"), F.count(F.lit(1))) * 100, F.lit(0.0)), 2
        ),
        "distinct_count": lambda c: F.approx_count_distinct(col(c)),
    }
    result = _per_column(df, list(df.columns), measures)
    if exact_percentiles:
        found = exact_quantiles_of(df, {c: number(df, c) for c in df.columns if c in numeric}, (0.25, 0.5, 0.75))
        rows = [(c, *found.get(c, (None, None, None))) for c in df.columns]
        quartiles = df.sparkSession.createDataFrame(rows, "column string, q25 double, q50 double, q75 double")
        result = result.join(F.broadcast(quartiles), "column").withColumns(
            {q: F.round(col(q), 2) for q in ("q25", "q50", "q75")}
        )
    else:
        result = result.withColumns(
            {q: F.round(F.get("quartiles", F.lit(i)), 2) for i, q in enumerate(("q25", "q50", "q75"))}
        )
    return result.select(
        "column", "type", "count", "min", "max", "avg", "std", "q25", "q50", "q75", "null_percentage", "distinct_count"
    )


# Column names that mark a role, by analysis.
ROLE_NAMES = {
    "entity": ("customer", "product", "item", "region", "category", "entity"),
    "metric": ("amount", "revenue", "price", "quantity", "value", "total"),
    "amount": ("amount", "price", "quantity", "value", "total", "cost", "revenue"),
    "category": ("category", "region", "status", "department", "type", "group"),
    "date": ("date", "timestamp", "created_at", "time", "datetime"),
    "growth_date": ("date", "timestamp", "created_at", "year", "month"),
    "fresh_date": ("date", "timestamp", "created_at", "updated_at"),
    "trend_value": ("amount", "total", "value", "price", "revenue", "sales", "cost", "quantity", "count"),
    "status": ("status", "state", "active"),
    "region": ("region", "area", "location", "category"),
}
# The sample analyses' own names of an amount, and the names that their fallbacks pass over.
SAMPLE_AMOUNTS = ("amount", "price", "value", "total", "revenue", "cost")
NOT_A_SAMPLE_AMOUNT = {
    "sample_data_demo": ("id", "name", "description", "category", "region", "date"),
    "sample_data_sql_examples": ("id", "name", "description", "date", "created_at"),
}
# Names never taken as the fallback number of a time trend.
NOT_A_METRIC = ("id", "name", "description", "category", "status")


def find_role(columns: Sequence[str], role: str, override: str | None = None) -> str | None:
    """The column playing a role: an override, or the first column with a listed name."""
    if override is not None:
        return override
    names = ROLE_NAMES[role]
    if role == "trend_value":
        # Here the order of the listed names decides, not the order of the columns.
        by_name: dict[str, str] = {}
        for c in columns:
            by_name.setdefault(c.lower(), c)
        return next((by_name[n] for n in names if n in by_name), None)
    return next((c for c in columns if c.lower() in names), None)


def sample_amount(columns: Sequence[str], analysis: str, override: str | None = None) -> str | None:
    """The amount of a sample analysis: a listed name, else the first column that its fallback allows."""
    if override is not None:
        return override
    found = next((c for c in columns if c.lower() in SAMPLE_AMOUNTS), None)
    return found or next((c for c in columns if c.lower() not in NOT_A_SAMPLE_AMOUNT[analysis]), None)


def trend_value_column(columns: Sequence[str], date_column: str) -> str | None:
    found = find_role(columns, "trend_value")
    if found:
        return found
    return next((c for c in columns if c != date_column and c.lower() not in NOT_A_METRIC), None)


def column_kinds(df: DataFrame, max_levels: int = 10) -> DataFrame:
    """Per column: numeric type, date-like (every value parses), distinct values, low cardinality."""
    names = business_columns(df)

    def date_like(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(True)
        if not isinstance(kind, T.StringType):
            return F.lit(False)
        return F.count_if(col(c).isNotNull() & col(c).try_cast("timestamp_ntz").isNull()) == 0

    result = _per_column(
        df,
        names,
        {
            "is_numeric": lambda c: F.lit(is_numeric_type(df.schema[c].dataType)),
            "is_date": date_like,
        },
    )
    # Distinct values of all columns in one shuffle of (column, value) pairs, combined on the map side.
    cells = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("v")) for c in names])
    pairs = df.select(F.explode(cells).alias("p")).select("p.name", "p.v").where("v is not null").distinct()
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("__n"))
    # One row per column on both sides.
    result = result.join(F.broadcast(counts), col("column") == col("name"), "left")
    result = result.withColumn("distinct_values", F.coalesce("__n", F.lit(0)))
    return result.select(
        "column",
        "is_numeric",
        "is_date",
        "distinct_values",
        (~col("is_numeric") & ~col("is_date")).alias("is_category"),
        (col("distinct_values") < max_levels).alias("is_low_cardinality"),
    )


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows, by row lineage where the table has it."""
    return (df.orderBy(ROW) if ROW in df.columns else df).limit(n)
