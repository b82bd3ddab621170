"""Named analyses: functions from a table to named result tables.

Columns are found by name unless given as ``roles``.  An analysis without the
columns it needs returns fewer results, or none.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import ROW, business_columns, col, is_numeric_type, number, sort_rows
from ..operators import aggregate as agg
from ..operators import entities, features, filters, ordered, pivot, profile, quality, timeline
from ..operators.joins import above_average, join_group_average, lookup
from ..staging import stage

Results = dict[str, DataFrame]

# A result under this name replaces the table, so later analyses see its columns.
NEW_TABLE = "table"


#: Column roles that a caller may name; every analysis takes all of them and uses those it has a use for.
ROLES = ("amount", "category", "second", "date", "timestamp", "status", "region", "entity", "tie", "hour", "as_of")


def _named(df: DataFrame, roles: dict, *names: str) -> str | None:
    """The first of the roles that the caller has named, else the first of the names that is a column."""
    return next((roles[n] for n in names if roles.get(n)), None) or next((c for n in names for c in df.columns if c.lower() == n), None)


def _role(df: DataFrame, role: str, roles: dict, key: str | None = None) -> str | None:
    return profile.find_role(business_columns(df), role, roles.get(key or role))


def basic_patterns(df: DataFrame, **roles: str) -> Results:
    """Median filter, group totals, top groups, shares."""
    amount = _role(df, "amount", roles)
    if amount is None:
        return {}
    names = business_columns(df)
    category = _role(df, "category", roles) or names[0]
    out = {
        "high_value": filters.at_least_median(df, amount),
        "by_category": agg.aggregate(df, category, amount),
    }
    second = next((c for c in names if c not in (category, amount)), None)
    if second and len(names) >= 3:
        out["by_two"] = agg.aggregate(df, [category, second], amount)
    out["top_groups"] = agg.top_groups(df, category, amount)
    out["share"] = agg.share_of_total(df, category, amount)
    out["count_total_average"] = agg.count_total_average(df, category, amount)
    return out


def time_analysis(df: DataFrame, **roles: str) -> Results:
    """Daily, monthly, weekday and hourly profiles, moving average, growth."""
    date = _role(df, "date", roles)
    if date is None:
        return {}
    value = roles.get("amount") or profile.trend_value_column(business_columns(df), date)
    if value is None:
        return {}
    out = {
        "daily": timeline.daily_trend(df, date, value, 30),
        "monthly": timeline.monthly_totals(df, date, value, 12),
        "day_of_week": timeline.day_of_week(df, date, value),
        "moving_average": timeline.moving_average(df, date, value, limit=14),
        "month_over_month": timeline.month_over_month(df, date, value, 6),
    }
    if "timestamp" in date.lower() or "datetime" in date.lower() or "hour" in roles:
        out["hourly"] = timeline.hourly(df, date, value)
    return out


def data_quality(df: DataFrame, **roles: str) -> Results:
    """Coverage, duplicates, number patterns, outliers, common values, freshness."""
    names = business_columns(df)
    out = {
        "coverage": profile.coverage(df),
        "low_coverage": profile.low_coverage(df),
        "duplicates": quality.duplicate_summary(df),
        "duplicate_groups": quality.duplicate_groups(df, limit=5),
        "numeric_patterns": profile.numeric_patterns(df),
    }
    # Column names checked for outliers, and names not profiled by value.
    listed = ("amount", "price", "quantity", "value", "total", "cost")
    skipped = ("amount", "price", "quantity", "date", "timestamp")
    metrics = [roles["amount"]] if roles.get("amount") else [c for c in names if c in listed]
    for c in metrics:
        out["outliers" if c == metrics[0] else f"outliers_{c}"] = quality.outliers(df, c)
    for c in names:
        if c not in skipped:
            out[f"top_values_{c}"] = agg.top_values(df, c, 5)
    date = _role(df, "fresh_date", roles, "date")
    if date:
        out["freshness"] = quality.freshness(df, date, roles.get("as_of"))
    return out


def business_metrics(df: DataFrame, **roles: str) -> Results:
    """Pareto, quintiles, percent ranks, growth, concentration, mean against median."""
    entity = _role(df, "entity", roles) or business_columns(df)[0]
    amount = _role(df, "metric", roles, "amount")
    if amount is None:
        return {}
    out = {
        "pareto": entities.pareto(df, entity, amount),
        "quintiles": entities.quintiles(df, entity, amount),
        "percentile_ranks": entities.percentile_ranks(df, entity, amount),
    }
    date = _role(df, "growth_date", roles, "date")
    if date:
        out["year_over_year"] = timeline.year_over_year(df, date, amount, 5)
    out["concentration"] = entities.concentration(df, entity, amount)
    out["central_tendency"] = entities.central_tendency(df, entity, amount)
    return out


def _ties(df: DataFrame, roles: dict) -> list[ordered.Key]:
    """The tie-breaker: a named column, else the row number; without one the scan brings its own."""
    name = roles.get("tie") or (ROW if ROW in df.columns else None)
    return [ordered.asc(name)] if name else []


def advanced_sql_patterns(df: DataFrame, **roles: str) -> Results:
    """Running totals, moving averages, ranks, row-over-row change, difference from the group mean."""
    amount = _named(df, roles, "amount") or _role(df, "amount", roles)
    if amount is None:
        return {}
    timestamp = _named(df, roles, "timestamp", "date") or _role(df, "date", roles)
    status = _named(df, roles, "status") or _role(df, "status", roles)
    ties = _ties(df, roles)
    out: Results = {}
    if timestamp:
        out |= _over_time(df.where(col(amount).isNotNull() & col(timestamp).isNotNull()), amount, timestamp, ties)
    ranks = ordered.scan(
        df.where(col(amount).isNotNull()),
        [ordered.desc(amount)],
        {
            "row_num": ordered.row_number(),
            "rank_amount": ordered.rank(),
            "dense_rank_amount": ordered.dense_rank(),
        },
        tie=ties,
    )
    out["ranks"] = ranks.orderBy(col("row_num"))
    if status:
        means = join_group_average(
            df, status, amount, how="inner", mean_name="category_avg", diff_name="diff_from_avg"
        )
        out["difference_from_average"] = sort_rows(means, F.desc_nulls_last("diff_from_avg"))
    return out


def _over_time(by_time: DataFrame, amount: str, timestamp: str, ties: list[ordered.Key]) -> Results:
    timed = ordered.scan(
        by_time,
        [ordered.asc(timestamp)],
        {"running_total": ordered.running_sum(amount)},
        tie=ties,
    )
    near = ordered.scan(
        by_time,
        [ordered.asc(timestamp)],
        {"moving_avg_3_period": ordered.moving_avg(amount, 3), "prev_amount": ordered.lag(amount)},
        tie=ties,
    ).withColumn("growth", col(amount) - col("prev_amount"))
    return {
        "running_total": sort_rows(timed, col(timestamp)),
        "moving_average": sort_rows(near.drop("prev_amount", "growth"), col(timestamp)),
        "row_over_row": sort_rows(near.drop("moving_avg_3_period"), col(timestamp)),
    }


def cohort_funnel(df: DataFrame, **roles: str) -> Results:
    """Acquisition cohorts, conversion funnel, retention."""
    entity = _named(df, roles, "entity") or _named(df, {}, "id") or _role(df, "entity", roles)
    timestamp = _named(df, roles, "timestamp", "date") or _role(df, "date", roles)
    status = _named(df, roles, "status") or _role(df, "status", roles)
    amount = _named(df, roles, "amount") or _role(df, "amount", roles)
    if entity is None:
        return {}
    out: Results = {}
    if timestamp:
        out["cohorts"] = timeline.acquisition_cohorts(df, entity, timestamp)
    if status and amount:
        out["funnel"] = agg.funnel(df, entity, [status, amount], col(status) == "active", number(df, amount) > 5000)
    if timestamp:
        out["retention"] = timeline.retention(df, entity, timestamp)
    return out


def value_patterns(df: DataFrame, **roles: str) -> Results:
    """Above-median rows, group summary, value bands, text features, group mean, ranks, missing cells."""
    names = business_columns(df)
    value = roles.get("amount") or names[0]
    texts = [c for c in features.text_columns(df) if c != value]
    category = roles.get("category") or (texts[0] if texts else None)
    out = {
        "preview": profile.preview(df, 5),
        "above_median": filters.above_median(df, value),
        "bands": filters.median_bands(df, value),
        "ranking": value_ranking(df, value),
        "missing": profile.missing_counts(df),
    }
    if texts:
        out["text"] = filters.with_text_features(df, texts[0])
    if category:
        out["group_summary"] = agg.group_summary(df, category, value, 5)
        out["with_group_mean"] = join_group_average(df, category, value, mean_name="avg_value", diff_name=None)
        out["pivot_summary"] = agg.pivot_summary(df, category, value)
    return out


def value_ranking(df: DataFrame, value: str) -> DataFrame:
    """Average rank (largest first) and ascending rank as a share of the numeric rows.

    Distinct values are counted before they are ordered, so ties of any size are
    one row in the ordered scan.
    """
    kept = df.withColumn("__v", number(df, value))
    counts = stage(kept.where("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).alias("__n")), "values")
    ranked = ordered.scan(counts, [ordered.asc("__v")], {"__upto": ordered.running_sum("__n")})
    all_rows = counts.agg(F.sum("__n").alias("__all"))
    middle = col("__upto") - (col("__n") - 1) / F.lit(2.0)
    places = ranked.crossJoin(F.broadcast(all_rows)).select(
        "__v",
        (col("__all") + 1 - middle).alias("rank"),
        (middle / col("__all")).alias("percentile"),
    )
    return lookup(kept, places, ["__v"], "left").select(*[col(c) for c in df.columns], "rank", "percentile")


def advanced_analytics(df: DataFrame, **roles: str) -> Results:
    """Date features, rolling metrics, group metrics, cross-tab, group mean per row."""
    numeric = features.numeric_columns(df)
    value = roles.get("amount") or (numeric[0] if numeric else None)
    if value is None:
        return {}
    date = roles.get("date") or roles.get("timestamp")
    if date is None:
        kinds = {r["column"]: r for r in profile.column_kinds(df).collect()}
        date = next((c for c, k in kinds.items() if k["is_date"]), None)
        texts = [c for c, k in kinds.items() if k["is_category"]]
    else:
        texts = [c for c in features.text_columns(df) if c != date]
    category = roles.get("category") or (texts[0] if texts else None)
    second = roles.get("second") or next((c for c in texts if c != category), None)
    out: Results = {}
    if date:
        out["date_features"] = filters.with_date_features(df, date)
        out["rolling"] = rolling(df, date, value, _ties(df, roles))
    if category:
        out["group_metrics"] = agg.group_metrics(df, category, value)
        out["group_mean"] = join_group_average(df, category, value)
        if second:
            out["crosstab"] = pivot.crosstab_percent(df, category, second)
    return out


def rolling(df: DataFrame, date: str, value: str, ties: str | list[ordered.Key] = (), rows: int = 3) -> DataFrame:
    """Mean and sum over the last rows by date; rows whose date does not parse are dropped."""
    dated = df.withColumn("__at", col(date).try_cast("timestamp_ntz")).where("__at is not null")
    return ordered.scan(
        dated.withColumn("__v", number(df, value)),
        [ordered.asc("__at")],
        {f"rolling_{rows}_avg": ordered.moving_avg("__v", rows), f"rolling_{rows}_sum": ordered.moving_sum("__v", rows)},
        tie=[ordered.asc(ties)] if isinstance(ties, str) else ties,
    ).drop("__at", "__v")


def ml_prep(df: DataFrame, **roles: str) -> Results:
    """Imputation, one-hot columns, scaling of the first number, correlations."""
    numeric = features.numeric_columns(df)
    if not numeric:
        return {}
    imputed = stage(features.impute(df), "imputed")
    encoded = features.one_hot(imputed)
    scaled = features.scale(encoded, numeric[0])
    wide = [f.name for f in scaled.schema if is_numeric_type(f.dataType) and f.name != "_row"]
    return {
        "imputed": imputed,
        "encoded": encoded,
        "scaled": scaled.select(numeric[0], f"{numeric[0]}_minmax", f"{numeric[0]}_standardized"),
        "correlation": features.correlation(scaled, wide),
    }


def sample_demo(df: DataFrame, **roles: str) -> Results:
    """Coverage, preview, tiers, filtered rows and roll-ups by region and tier."""
    amount = profile.sample_amount(business_columns(df), "sample_data_demo", roles.get("amount"))
    if amount is None:
        return {}
    status, region = _role(df, "status", roles), _role(df, "region", roles)
    tiered = filters.tiers(df, amount)
    out = {
        "coverage": profile.coverage(df),
        "preview": profile.preview(df, 5),
        NEW_TABLE: tiered,
        "filtered": filters.status_and_amount(tiered, status, amount),
        "by_tier": agg.aggregate(tiered, "tier", amount, "AVG"),
    }
    groups = ["tier"]
    source = tiered
    if region:
        out["by_region"] = agg.aggregate(tiered, region, amount)
        out["region_by_tier"] = pivot.pivot(tiered, region, "tier", amount)
        if status:
            groups, source = [region, "tier"], tiered.where(col(status) == "active")
    out["summary"] = agg.count_total_average(
        source, groups, amount, count_name="n", total_name="total_amount", average_name="avg_amount"
    )
    return out


def sample_sql(df: DataFrame, **roles: str) -> Results:
    """Region statistics, rank within region, value tiers, high and above-average values."""
    amount = profile.sample_amount(business_columns(df), "sample_data_sql_examples", roles.get("amount"))
    region = _role(df, "region", roles)
    if amount is None:
        return {}
    out = {
        "preview": profile.preview(df, 5),
        "value_tiers": sort_rows(filters.value_tiers(df, amount), col(amount).desc_nulls_last()),
        "high_values": filters.high_values(df, amount),
        "above_average": above_average(df, amount),
    }
    if region:
        out["by_region"] = agg.count_total_average(
            df, region, amount, count_name="count", total_name="total_amount", average_name="avg_amount"
        )
        out["rank_in_region"] = rank_in_group(df, region, amount)
    return out


def rank_in_group(df: DataFrame, group: str, value: str, name: str | None = None) -> DataFrame:
    """RANK by value (largest first) within each group.

    A group may hold a large part of the rows, so this is the ordered scan over
    (group, value): the rank within the group is the global rank less the rows of
    earlier groups.
    """
    name = name or f"rank_in_{group}"
    ranked = ordered.scan(df, [ordered.asc(group), ordered.desc(value)], {"__rank": ordered.rank()})
    sizes = stage(df.groupBy(col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n")), "groups")
    starts = ordered.scan(sizes, [ordered.asc("__g")], {"__upto": ordered.running_sum("__n")})
    # NULL is a group of its own; a marker lets it match.
    starts = starts.select(col("__g").isNull().alias("__none"), F.coalesce(col("__g").cast("string"), F.lit("")).alias("__key"), (col("__upto") - col("__n")).alias("__before"))
    keyed = ranked.withColumns({"__none": col(group).isNull(), "__key": F.coalesce(col(group).cast("string"), F.lit(""))})
    joined = lookup(keyed, starts, ["__none", "__key"])
    return joined.select(*[col(c) for c in df.columns], (col("__rank") - col("__before")).alias(name))


def register(name: str, analysis: Callable[..., Results]) -> None:
    """Make a user's analysis available by name."""
    ANALYSES[name] = analysis


# The saved query library; names in braces are filled in by the caller.
SAVED_QUERIES = {
    "Select Top 10": "SELECT * FROM {table} ORDER BY ALL LIMIT 10",
    "Count by Category": "SELECT {category}, COUNT(*) AS count FROM {table} GROUP BY {category} ORDER BY count DESC NULLS LAST",
    "Sum by Category": "SELECT {category}, SUM(TRY_CAST({amount} AS DOUBLE)) AS total FROM {table} "
    "GROUP BY {category} ORDER BY total DESC NULLS LAST",
    "Missing Values Check": "SELECT 'all_columns' AS col, COUNT(*) AS total, "
    "COUNT(*) FILTER (WHERE {column} IS NULL) AS missing FROM {table}",
    "Date Trend (Daily)": "SELECT CAST({date} AS DATE) AS d, COUNT(*) AS count FROM {table} GROUP BY 1 ORDER BY d NULLS LAST",
    "Value Distribution": "SELECT {amount}, COUNT(*) AS count FROM {table} GROUP BY {amount} "
    "ORDER BY count DESC, {amount} LIMIT 20",
}

ANALYSES: dict[str, Callable[..., Results]] = {
    "basic_patterns": basic_patterns,
    "time_analysis": time_analysis,
    "data_quality": data_quality,
    "business_metrics": business_metrics,
    "advanced_sql_patterns": advanced_sql_patterns,
    "sql_cohort_funnel": cohort_funnel,
    "python_patterns": value_patterns,
    "python_advanced_analytics": advanced_analytics,
    "python_ml_prep": ml_prep,
    "sample_data_demo": sample_demo,
    "sample_data_sql_examples": sample_sql,
}
