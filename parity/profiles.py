"""Metadata and column profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import Workbench
from tabloom.operators import profile, quantiles

from .registry import GAPS_SQL, gaps, query, table


def _per_column(columns, select):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.format(c=c)}" for c in columns)


_GAPS = ("event_id", "ts", "user_id", "event_type", "amount", "kind")
_PRESENT = "COUNT(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '')"


@query(
    "coverage",
    "WITH g AS (" + GAPS_SQL + ") "
    + _per_column(
        _GAPS, _PRESENT + ' AS present, ROUND(' + _PRESENT + ' * 100.0 / COUNT(*), 1)::DOUBLE AS "coverage_%" FROM g'
    ),
)
def coverage(spark, sf_dir):
    return profile.coverage(gaps(spark, sf_dir))


@query(
    "low_coverage",
    "WITH g AS (" + GAPS_SQL + '), c AS ('
    + _per_column(
        _GAPS, _PRESENT + ' AS present, ROUND(' + _PRESENT + ' * 100.0 / COUNT(*), 1)::DOUBLE AS "coverage_%" FROM g'
    )
    + ') SELECT * FROM c WHERE "coverage_%" < 97',
)
def low_coverage(spark, sf_dir):
    return profile.low_coverage(gaps(spark, sf_dir), 97.0)


@query(
    "missing_counts",
    "WITH g AS (" + GAPS_SQL + "), m AS ("
    + _per_column(_GAPS, "COUNT(*) - COUNT({c}) AS missing_count FROM g")
    + ") SELECT * FROM m WHERE missing_count > 0",
)
def missing_counts(spark, sf_dir):
    return profile.missing_counts(gaps(spark, sf_dir))


@query(
    "numeric_patterns",
    "WITH g AS (" + GAPS_SQL + ") "
    + _per_column(
        _GAPS,
        "COUNT(*) AS total, COUNT(*) FILTER (REGEXP_FULL_MATCH(CAST({c} AS VARCHAR), '[0-9]*\\.?[0-9]+')) AS numeric_count,"
        " COUNT(*) FILTER (CAST({c} AS VARCHAR) = '') AS empty_count,"
        " COUNT(*) FILTER (REGEXP_FULL_MATCH(CAST({c} AS VARCHAR), '[0-9]*\\.?[0-9]+')) = COUNT(*) AS is_numeric FROM g",
    ),
)
def numeric_patterns(spark, sf_dir):
    return profile.numeric_patterns(gaps(spark, sf_dir))


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


_KINDS = ("bigint", "bigint", "bigint", "int", "double", "double", "double", "double")


@query(
    "summarize_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, COUNT(*) AS count, ROUND(MIN({c})::DOUBLE, 2) AS min, ROUND(MAX({c})::DOUBLE, 2) AS max, "
        f"ROUND(AVG({c}), 2) AS avg, ROUND(STDDEV_SAMP({c}), 2) AS std, "
        f"ROUND(QUANTILE_CONT({c}::DOUBLE, 0.25), 2) AS q25, ROUND(QUANTILE_CONT({c}::DOUBLE, 0.5), 2) AS q50, "
        f"ROUND(QUANTILE_CONT({c}::DOUBLE, 0.75), 2) AS q75, "
        f"ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 2)::DOUBLE AS null_percentage FROM lineitem"
        for c, kind in zip(_NUMERIC, _KINDS)
    ),
)
def summarize_numeric(spark, sf_dir):
    rows = profile.summarize(table(spark, sf_dir, "lineitem").select(*_NUMERIC), exact_percentiles=True)
    return rows.drop("distinct_count")


#: A sketched quartile must lie between the values at these distances from its rank: twice the stated error of 99 in 100.
_OFF = 0.01
_QUARTILES = (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))


@query(
    "summarize",
    _per_column(
        _NUMERIC,
        "COUNT(*) AS count, ROUND(MIN({c})::DOUBLE, 2) AS min, ROUND(MAX({c})::DOUBLE, 2) AS max, ROUND(AVG({c}), 2) AS avg, "
        "ROUND(STDDEV_SAMP({c}), 2) AS std, "
        + "".join(f"ROUND(QUANTILE_CONT({{c}}::DOUBLE, {p}), 2) AS {q}, " for q, p in _QUARTILES)
        + "ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 2)::DOUBLE AS null_percentage, "
        "COUNT(DISTINCT {c}) AS distinct_values, MIN({c}) IS NOT NULL AS in_order, COUNT({c}) > 0 AS quartiles_within, "
        "COUNT({c}) > 0 AS distinct_within FROM lineitem",
    ),
)
def summarize(spark, sf_dir):
    """All that is exact, whether the sketched quartiles lie in order, and whether the sketches lie within their stated errors."""
    rows = table(spark, sf_dir, "lineitem").select(*_NUMERIC)
    sketched = profile.summarize(rows)
    ordered = (F.col("min") <= F.col("q25")) & (F.col("q25") <= F.col("q50")) & (F.col("q50") <= F.col("q75")) & (F.col("q75") <= F.col("max"))
    sketched = sketched.withColumn("in_order", ordered).withColumnsRenamed({q: f"sketched_{q}" for q, _ in _QUARTILES})
    exact = profile.summarize(rows, exact_percentiles=True).select("column", *[q for q, _ in _QUARTILES])
    counted = profile.column_kinds(rows).select("column", "distinct_values")
    # One row per column in each.
    found = sketched.join(exact, "column").join(counted, "column").join(_rank_bounds(rows), "column")
    near = [F.col(f"sketched_{q}").between(F.col(f"least_{q}"), F.col(f"most_{q}")) for q, _ in _QUARTILES]
    missed = F.abs(F.col("distinct_count") - F.col("distinct_values"))
    held = (F.col("distinct_values") > 0) & (missed <= 3 * profile.DISTINCT_ERROR * F.col("distinct_values") + 1)
    return found.select(
        "column", "count", "min", "max", "avg", "std", *[q for q, _ in _QUARTILES], "null_percentage", "distinct_values", "in_order",
        F.coalesce(near[0] & near[1] & near[2], F.lit(False)).alias("quartiles_within"),
        held.alias("distinct_within"),
    )


def _rank_bounds(rows):
    """Per column the exact values at the ranks on both sides of each quartile's, rounded like a summary's."""
    assert 2 * profile.rank_error() <= _OFF
    exact = quantiles.exact_quantiles_of(rows, {c: F.col(c) for c in rows.columns}, [r for _, p in _QUARTILES for r in (p - _OFF, p + _OFF)])
    names = [f"{end}_{q}" for q, _ in _QUARTILES for end in ("least", "most")]
    # One row per column.
    bounds = rows.sparkSession.createDataFrame([(c, *exact[c]) for c in rows.columns], ", ".join(["column string", *[f"{n} double" for n in names]]))
    return F.broadcast(bounds.withColumns({n: F.round(n, 2) for n in names}))


@query(
    "summarize_sketches",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{q}' AS quartile, ROUND(QUANTILE_CONT({c}::DOUBLE, {p - _OFF}), 2) AS least, "
        f"ROUND(QUANTILE_CONT({c}::DOUBLE, {p + _OFF}), 2) AS most, COUNT({c}) > 0 AS within FROM lineitem"
        for c in _NUMERIC
        for q, p in _QUARTILES
    ),
)
def summarize_sketches(spark, sf_dir):
    """Sketched quartiles are held to the exact values at the ranks next to theirs, not to a distance in value."""
    rows = table(spark, sf_dir, "lineitem").select(*_NUMERIC)
    sketched = profile.summarize(rows).select("column", F.expr("stack(3, 'q25', q25, 'q50', q50, 'q75', q75) AS (quartile, estimate)"))
    assert 2 * profile.rank_error() <= _OFF
    exact = quantiles.exact_quantiles_of(rows, {c: F.col(c) for c in _NUMERIC}, [r for _, p in _QUARTILES for r in (p - _OFF, p + _OFF)])
    places = [(c, q, exact[c][2 * i], exact[c][2 * i + 1]) for c in _NUMERIC for i, (q, _) in enumerate(_QUARTILES)]
    # One row per column and quartile.
    bounds = spark.createDataFrame(places, "column string, quartile string, least double, most double")
    bounds = bounds.withColumns({b: F.round(b, 2) for b in ("least", "most")})
    found = sketched.join(F.broadcast(bounds), ["column", "quartile"])
    return found.select("column", "quartile", "least", "most", F.col("estimate").between(F.col("least"), F.col("most")).alias("within"))


def _whole_summary(c: str, kind: str) -> str:
    number = kind != "string"
    statistic = lambda sql: f"ROUND({sql}, 2)" if number else "NULL::DOUBLE"
    edge = lambda f: f"ROUND(TRY_CAST({f}({c}) AS DOUBLE), 2)"
    return (
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, COUNT(*) AS count, {edge('MIN')} AS min, {edge('MAX')} AS max, "
        f"{statistic(f'AVG({c})')} AS avg, {statistic(f'STDDEV_SAMP({c})')} AS std, "
        + ", ".join(statistic(f"QUANTILE_CONT({c}::DOUBLE, {p})") + f" AS {q}" for q, p in _QUARTILES)
        + f", ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 2)::DOUBLE AS null_percentage, "
        f"COUNT(DISTINCT {c}) AS distinct_values, COUNT(DISTINCT {c}) > 0 AS distinct_within FROM documents"
    )


@query(
    "summarize_documents",
    " UNION ALL ".join(
        _whole_summary(c, kind)
        for c, kind in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    ),
)
def summarize_documents(spark, sf_dir):
    """The whole summary of a table with text columns; the distinct estimate is held to the exact count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    found = profile.summarize(docs, exact_percentiles=True).join(profile.column_kinds(docs).select("column", "distinct_values"), "column")
    near = F.abs(F.col("distinct_count") - F.col("distinct_values")) <= 3 * profile.DISTINCT_ERROR * F.col("distinct_values")
    return found.withColumn("distinct_within", near).drop("distinct_count")


_SCHEMA = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))


@query(
    "schema_table",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS column_type, COUNT({c}) AS present FROM customer"
        for i, (c, t) in enumerate(_SCHEMA)
    ),
)
def schema_table(spark, sf_dir):
    work = Workbench(spark)
    work.register("customer", table(spark, sf_dir, "customer"))
    filled = work.coverage().select(F.col("column").alias("column_name"), "present")
    return work.schema().join(filled, "column_name")


@query(
    "column_kinds",
    "WITH g AS (" + GAPS_SQL + "), k AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {n} AS is_numeric, {d} AS is_date, COUNT(DISTINCT {c}) AS distinct_values FROM g"
        for c, n, d in (
            ("event_id", True, False),
            ("ts", False, True),
            ("user_id", True, False),
            ("event_type", False, False),
            ("amount", False, False),
            ("kind", False, False),
        )
    )
    + ") SELECT *, NOT is_numeric AND NOT is_date AS is_category, distinct_values < 10 AS is_low_cardinality FROM k",
)
def column_kinds(spark, sf_dir):
    return profile.column_kinds(gaps(spark, sf_dir))


@query("preview", "SELECT event_id, ts, value FROM events ORDER BY ts LIMIT 10")
def preview(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    # The time of an event stands in for the lineage column of a loaded file.
    return profile.preview(events.withColumn("_row", F.col("ts")), 10).drop("_row")


@query(
    "table_info",
    "SELECT 'customer' AS \"table\", 'parquet' AS format, COUNT(*) AS rows, 5::BIGINT AS columns FROM customer",
)
def table_info(spark, sf_dir):
    work = Workbench(spark).load(f"{sf_dir}/customer.parquet")
    info = work.info()
    row = (info["table"], info["format"], info["rows"], len(info["columns"]))
    return spark.createDataFrame([row], "table string, format string, rows long, columns long")
