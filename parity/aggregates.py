"""Aggregates, pivots, cross-tabulations, duplicates, entity KPIs and charts."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import Workbench, desc
from tabloom.operators import aggregate as agg
from tabloom.operators import entities, pivot, profile, quality
from tabloom.operators.ordered import asc

from .registry import GAPS_SQL, gaps, query, table


@query(
    "aggregate_sum",
    """SELECT l_returnflag, COUNT(*) AS count, ROUND(SUM(l_extendedprice), 2) AS sum_l_extendedprice
       FROM lineitem GROUP BY l_returnflag""",
)
def aggregate_sum(spark, sf_dir):
    return agg.aggregate(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "SUM")


@query(
    "aggregate_two_groups",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS count, ROUND(AVG(l_quantity), 2) AS avg_l_quantity
       FROM lineitem GROUP BY ALL""",
)
def aggregate_two_groups(spark, sf_dir):
    return agg.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "AVG")


@query(
    "aggregate_text_field",
    f"""SELECT kind, COUNT(*) AS count, ROUND(SUM(TRY_CAST(amount AS DOUBLE)), 2) AS sum_amount
        FROM ({GAPS_SQL}) WHERE amount IS NOT NULL AND amount <> '' GROUP BY kind""",
)
def aggregate_text_field(spark, sf_dir):
    return agg.aggregate(gaps(spark, sf_dir), "kind", "amount", "SUM")


@query(
    "aggregate_min_max",
    """SELECT o_orderpriority, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(o_totalprice) AS n,
              ROUND(MEDIAN(o_totalprice), 2) AS med FROM orders GROUP BY o_orderpriority""",
)
def aggregate_min_max(spark, sf_dir):
    work = Workbench(spark)
    work.register("orders", table(spark, sf_dir, "orders"))
    parts = {
        f: work.aggregate("o_orderpriority", "o_totalprice", f).drop("count") for f in ("MIN", "MAX", "COUNT")
    }
    joined = parts["MIN"].join(parts["MAX"], "o_orderpriority").join(parts["COUNT"], "o_orderpriority")
    medians = work.aggregate("o_orderpriority", "o_totalprice", "MEDIAN").select("o_orderpriority", F.col("median_o_totalprice").alias("med"))
    return joined.join(medians, "o_orderpriority").select(
        "o_orderpriority",
        F.col("min_o_totalprice").alias("lo"),
        F.col("max_o_totalprice").alias("hi"),
        F.col("count_o_totalprice").cast("long").alias("n"),
        "med",
    )


@query(
    "count_total_average",
    """SELECT o_orderstatus, COUNT(*) AS record_count, ROUND(SUM(o_totalprice), 2) AS total,
              ROUND(AVG(o_totalprice), 2) AS average FROM orders GROUP BY o_orderstatus""",
)
def count_total_average(spark, sf_dir):
    return agg.count_total_average(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")


@query(
    "top_groups",
    """SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey
       ORDER BY total DESC, o_custkey LIMIT 5""",
)
def top_groups(spark, sf_dir):
    top = agg.top_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")
    return top.withColumn("total", F.round("total", 2))


@query(
    "top_groups_excluding",
    """SELECT p_brand, ROUND(SUM(p_retailprice), 2) AS total FROM part WHERE p_brand NOT LIKE 'Brand#9'
       GROUP BY p_brand ORDER BY total DESC, p_brand LIMIT 10""",
)
def top_groups_excluding(spark, sf_dir):
    top = agg.top_groups(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 10, exclude=["Brand#9"])
    return top.withColumn("total", F.round("total", 2))


@query(
    "share_of_total",
    """SELECT p_type, ROUND(SUM(p_retailprice), 2) AS total,
              ROUND(100 * SUM(p_retailprice) / SUM(SUM(p_retailprice)) OVER (), 2) AS percentage
       FROM part GROUP BY p_type""",
)
def share_of_total(spark, sf_dir):
    return agg.share_of_total(table(spark, sf_dir, "part"), "p_type", "p_retailprice").withColumn(
        "total", F.round("total", 2)
    )


@query(
    "top_values",
    f"""SELECT amount AS value, COUNT(*) AS count, ROUND(100 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS percentage
        FROM ({GAPS_SQL}) WHERE amount IS NOT NULL AND amount <> '' GROUP BY amount
        ORDER BY count DESC, amount LIMIT 5""",
)
def top_values(spark, sf_dir):
    return agg.top_values(gaps(spark, sf_dir), "amount", 5)


@query("value_counts", "SELECT p_brand, COUNT(*) AS count FROM part GROUP BY p_brand")
def value_counts(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "part"), "p_brand")


@query(
    "value_counts_limited",
    "SELECT l_quantity, COUNT(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, l_quantity LIMIT 20",
)
def value_counts_limited(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "lineitem"), "l_quantity", 20)


@query("value_counts_languages", "SELECT lang, COUNT(*) AS count FROM documents GROUP BY lang")
def value_counts_languages(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "documents"), "lang")


@query(
    "groups_having",
    """SELECT o_custkey, COUNT(*) AS count, ROUND(AVG(o_totalprice), 6) AS average FROM orders
       GROUP BY o_custkey HAVING COUNT(*) >= 12""",
)
def groups_having(spark, sf_dir):
    rows = agg.groups_having(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 12)
    return rows.withColumn("average", F.round("average", 6))


@query(
    "group_metrics",
    """SELECT c_mktsegment, COUNT(*) AS count_rows, ROUND(SUM(c_acctbal), 2) AS sum_values,
              ROUND(AVG(c_acctbal), 6) AS mean_values, MAX(c_acctbal) AS max_value,
              ROUND(100.0 * SUM(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / COUNT(*), 6) AS percent_positive
       FROM customer GROUP BY c_mktsegment""",
)
def group_metrics(spark, sf_dir):
    rows = agg.group_metrics(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return rows.withColumns(
        {
            "sum_values": F.round("sum_values", 2),
            "mean_values": F.round("mean_values", 6),
            "percent_positive": F.round("percent_positive", 6),
        }
    )


@query(
    "group_summary",
    f"""SELECT kind, ROUND(SUM(v), 2) AS total, ROUND(AVG(v), 6) AS average, COUNT(v) AS count
        FROM (SELECT kind, TRY_CAST(amount AS DOUBLE) AS v FROM ({GAPS_SQL})) WHERE kind IS NOT NULL
        GROUP BY kind ORDER BY total DESC LIMIT 5""",
)
def group_summary(spark, sf_dir):
    rows = agg.group_summary(gaps(spark, sf_dir), "kind", "amount")
    return rows.withColumns({"total": F.round("total", 2), "average": F.round("average", 6)})


@query(
    "pivot_summary",
    """SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS sum_l_quantity, ROUND(AVG(l_quantity), 6) AS mean_l_quantity,
              COUNT(l_quantity) AS count_l_quantity FROM lineitem GROUP BY l_returnflag""",
)
def pivot_summary(spark, sf_dir):
    rows = agg.pivot_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return rows.withColumns(
        {"sum_l_quantity": F.round("sum_l_quantity", 2), "mean_l_quantity": F.round("mean_l_quantity", 6)}
    )


@query(
    "pivot_sum",
    """SELECT o_orderpriority, ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS "F",
              ROUND(SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS "O",
              ROUND(SUM(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS "P"
       FROM orders GROUP BY o_orderpriority""",
)
def pivot_sum(spark, sf_dir):
    return pivot.pivot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")


_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "pivot_count",
    "SELECT user_id, "
    + ", ".join(f"CAST(COUNT(CASE WHEN event_type = '{e}' THEN value END) AS BIGINT) AS {e}" for e in _EVENT_TYPES)
    + " FROM events GROUP BY user_id",
)
def pivot_count(spark, sf_dir):
    return pivot.pivot(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "COUNT")


@query(
    "pivot_long",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL""",
)
def pivot_long(spark, sf_dir):
    return pivot.pivot_long(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")


@query(
    "crosstab_percent",
    """SELECT l_returnflag, ROUND(100.0 * COUNT(*) FILTER (l_linestatus = 'F') / COUNT(*), 6) AS "F",
              ROUND(100.0 * COUNT(*) FILTER (l_linestatus = 'O') / COUNT(*), 6) AS "O" FROM lineitem GROUP BY 1""",
)
def crosstab_percent(spark, sf_dir):
    wide = pivot.crosstab_percent(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return wide.select("l_returnflag", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query(
    "crosstab_margins",
    """SELECT COALESCE(l_returnflag, 'TOTAL') AS l_returnflag, COUNT(*) FILTER (l_linestatus = 'F') AS "F",
              COUNT(*) FILTER (l_linestatus = 'O') AS "O", COUNT(*) AS "TOTAL"
       FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
)
def crosstab_margins(spark, sf_dir):
    return pivot.crosstab_margins(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "crosstab_long",
    """SELECT COALESCE(o_orderstatus, 'TOTAL') AS "row", COALESCE(o_orderpriority, 'TOTAL') AS "column",
              COUNT(*) AS count FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
def crosstab_long(spark, sf_dir):
    return pivot.crosstab_long(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "funnel",
    f"""SELECT COUNT(*) AS step_1_total_events, COUNT(user_id) FILTER (kind = 'purchase') AS step_2_active_users,
               COUNT(user_id) FILTER (v > 100) AS step_3_high_value,
               CAST(COUNT(user_id) FILTER (kind = 'purchase') AS DOUBLE) / NULLIF(COUNT(*), 0) * 100
                   AS step1_to_2_conv_rate,
               CAST(COUNT(user_id) FILTER (v > 100) AS DOUBLE)
                   / NULLIF(COUNT(user_id) FILTER (kind = 'purchase'), 0) * 100 AS step2_to_3_conv_rate
        FROM (SELECT user_id, kind, amount, TRY_CAST(amount AS DOUBLE) AS v FROM ({GAPS_SQL}))
        WHERE kind IS NOT NULL AND amount IS NOT NULL""",
)
def funnel(spark, sf_dir):
    rows = gaps(spark, sf_dir)
    high = F.expr("try_cast(amount as double) > 100")
    return agg.funnel(rows, "user_id", ["kind", "amount"], F.col("kind") == "purchase", high)


@query(
    "duplicate_summary",
    """WITH g AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicate_count, CAST(SUM(n) AS BIGINT) AS total_rows,
              ROUND(100.0 * (SUM(n) - COUNT(*)) / SUM(n), 2) AS duplicate_pct FROM g""",
)
def duplicate_summary(spark, sf_dir):
    return quality.duplicate_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_summary_nulls",
    f"""WITH g AS (SELECT user_id, kind, amount, COUNT(*) AS n FROM ({GAPS_SQL}) GROUP BY ALL)
        SELECT CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicate_count, CAST(SUM(n) AS BIGINT) AS total_rows,
               ROUND(100.0 * (SUM(n) - COUNT(*)) / SUM(n), 2) AS duplicate_pct FROM g""",
)
def duplicate_summary_nulls(spark, sf_dir):
    return quality.duplicate_summary(gaps(spark, sf_dir), ["user_id", "kind", "amount"])


@query(
    "duplicate_summary_texts",
    """WITH g AS (SELECT lang, source, text, COUNT(*) AS n FROM documents GROUP BY ALL)
       SELECT CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicate_count, CAST(SUM(n) AS BIGINT) AS total_rows,
              ROUND(100.0 * (SUM(n) - COUNT(*)) / SUM(n), 2) AS duplicate_pct FROM g""",
)
def duplicate_summary_texts(spark, sf_dir):
    return quality.duplicate_summary(table(spark, sf_dir, "documents"), ["lang", "source", "text"])


@query(
    "duplicate_groups_texts",
    """SELECT source, text, COUNT(*) AS occurrence_count FROM documents GROUP BY ALL HAVING COUNT(*) > 1""",
)
def duplicate_groups_texts(spark, sf_dir):
    return quality.duplicate_groups(table(spark, sf_dir, "documents"), ["source", "text"])


@query(
    "duplicate_groups",
    """SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrence_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def duplicate_groups(spark, sf_dir):
    return quality.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_groups_sample",
    """SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrence_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1
       ORDER BY occurrence_count DESC, l_orderkey, l_linenumber LIMIT 5""",
)
def duplicate_groups_sample(spark, sf_dir):
    return quality.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 5)


@query(
    "first_per_key",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem
       QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) = 1""",
)
def first_per_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return quality.first_per_key(lines, ["l_orderkey"], [asc("l_linenumber"), asc("l_extendedprice"), asc("l_partkey")])


@query(
    "last_per_key",
    """SELECT user_id, ts, event_type, value FROM events
       QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""",
)
def last_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    return quality.first_per_key(events, ["user_id"], [desc("ts")])


@query(
    "outliers",
    """WITH s AS (SELECT QUANTILE_CONT(l_extendedprice, 0.25) AS q1, QUANTILE_CONT(l_extendedprice, 0.75) AS q3,
                         MEDIAN(l_extendedprice) AS m FROM lineitem),
            r AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m FROM s)
       SELECT COUNT(*) AS total_values, COUNT(*) FILTER (l_extendedprice < lo) AS low_outliers,
              COUNT(*) FILTER (l_extendedprice > hi) AS high_outliers, ROUND(MAX(m), 2) AS median,
              ROUND(MAX(lo), 2) AS lower_bound, ROUND(MAX(hi), 2) AS upper_bound FROM lineitem, r""",
)
def outliers(spark, sf_dir):
    return quality.outliers(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(
    "outliers_documents",
    """WITH s AS (SELECT QUANTILE_CONT(n_chars, 0.25) AS q1, QUANTILE_CONT(n_chars, 0.75) AS q3,
                         MEDIAN(n_chars) AS m FROM documents),
            r AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m FROM s)
       SELECT COUNT(*) AS total_values, COUNT(*) FILTER (n_chars < lo) AS low_outliers,
              COUNT(*) FILTER (n_chars > hi) AS high_outliers, ROUND(MAX(m), 2) AS median,
              ROUND(MAX(lo), 2) AS lower_bound, ROUND(MAX(hi), 2) AS upper_bound FROM documents, r""",
)
def outliers_documents(spark, sf_dir):
    return quality.outliers(table(spark, sf_dir, "documents"), "n_chars")


@query(
    "freshness",
    """SELECT MIN(o_orderdate) AS earliest_date, MAX(o_orderdate) AS latest_date,
              CAST(DATE '2002-01-01' - MAX(CAST(o_orderdate AS DATE)) AS BIGINT) AS days_old FROM orders""",
)
def freshness(spark, sf_dir):
    return quality.freshness(table(spark, sf_dir, "orders"), "o_orderdate", "2002-01-01")


_TOTALS = "SELECT o_custkey, SUM(CAST(o_totalprice AS DOUBLE)) AS total FROM orders GROUP BY o_custkey"


@query(
    "pareto",
    f"""WITH t AS ({_TOTALS}), g AS (SELECT SUM(total) AS grand, COUNT(*) AS n FROM t)
        SELECT o_custkey, ROUND(total, 2) AS total, ROUND(100 * total / grand, 2) AS pct_of_total,
               ROUND(100 * SUM(total) OVER (ORDER BY total DESC) / grand, 2) AS cumulative_pct,
               ROUND(100.0 * ROW_NUMBER() OVER (ORDER BY total DESC, o_custkey) / n, 2) AS percentile_rank
        FROM t, g""",
)
def pareto(spark, sf_dir):
    return entities.pareto(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


@query(
    "quintiles",
    f"""WITH t AS ({_TOTALS}),
             q AS (SELECT total, NTILE(5) OVER (ORDER BY total DESC, o_custkey) AS quintile FROM t)
        SELECT CAST(quintile AS BIGINT) AS quintile, COUNT(*) AS entity_count, ROUND(SUM(total), 2) AS group_total,
               ROUND(100 * SUM(total) / (SELECT SUM(total) FROM t), 2) AS contribution_pct FROM q GROUP BY 1""",
)
def quintiles(spark, sf_dir):
    return entities.quintiles(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


@query(
    "percentile_ranks",
    f"""WITH t AS ({_TOTALS}), p AS (SELECT *, PERCENT_RANK() OVER (ORDER BY total) AS pr FROM t)
        SELECT o_custkey, ROUND(total, 2) AS total, ROUND(100 * pr, 2) AS percentile_rank,
               CASE WHEN pr >= 0.9 THEN 'Top 10%' WHEN pr >= 0.75 THEN 'Top 25%' WHEN pr >= 0.5 THEN 'Top 50%'
                    ELSE 'Bottom 50%' END AS tier FROM p""",
)
def percentile_ranks(spark, sf_dir):
    return entities.percentile_ranks(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


@query(
    "concentration",
    f"""WITH t AS ({_TOTALS}), g AS (SELECT SUM(total) AS grand FROM t),
             r AS (SELECT total, ROW_NUMBER() OVER (ORDER BY total DESC, o_custkey) AS rank FROM t)
        SELECT 'Top ' || k AS metric, ROUND(SUM(total) / MAX(grand) * 100, 2) AS concentration_pct
        FROM r, g, (VALUES (3), (10), (25)) v(k) WHERE rank <= k GROUP BY k""",
)
def concentration(spark, sf_dir):
    return entities.concentration(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


@query(
    "central_tendency",
    """SELECT ROUND(AVG(o_totalprice), 2) AS mean_value, ROUND(MEDIAN(o_totalprice), 2) AS median_value,
              ROUND(100 * (AVG(o_totalprice) - MEDIAN(o_totalprice)) / NULLIF(MEDIAN(o_totalprice), 0), 2)
                  AS pct_difference,
              COUNT(*) AS total_records, COUNT(DISTINCT o_custkey) AS unique_entities FROM orders""",
)
def central_tendency(spark, sf_dir):
    return entities.central_tendency(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


@query(
    "count_distinct",
    """SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus""",
)
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


_KEYS = ("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "approximate_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS exact, FLOOR(COUNT(DISTINCT {c}) * 0.85)::BIGINT AS least, "
        f"CEIL(COUNT(DISTINCT {c}) * 1.15)::BIGINT AS most, COUNT(DISTINCT {c}) > 0 AS within FROM lineitem"
        for c in _KEYS
    ),
)
def approximate_distinct(spark, sf_dir):
    """The estimates of a summary lie within three standard errors (5 percent) of the exact counts."""
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS)
    estimates = profile.summarize(rows).select("column", F.col("distinct_count").alias("estimate"))
    counted = profile.column_kinds(rows).select("column", F.col("distinct_values").alias("exact"))
    bounds = estimates.join(counted, "column").withColumns({"least": F.floor(F.col("exact") * 0.85), "most": F.ceil(F.col("exact") * 1.15)})
    return bounds.select("column", "exact", "least", "most", F.col("estimate").between(F.col("least"), F.col("most")).alias("within"))


@query(
    "aggregate_median",
    """SELECT l_suppkey, l_returnflag, COUNT(*) AS count, ROUND(MEDIAN(l_quantity), 2) AS median_l_quantity
       FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def aggregate_median(spark, sf_dir):
    """A grouped median of the table API, exact, with no group's values in one buffer."""
    work = Workbench(spark)
    work.register("lineitem", table(spark, sf_dir, "lineitem"))
    return work.aggregate(["l_suppkey", "l_returnflag"], "l_quantity", "MEDIAN")


@query(
    "pivot_median",
    """SELECT o_orderpriority, MEDIAN(FLOOR(o_totalprice)) FILTER (o_orderstatus = 'F') AS "F",
              MEDIAN(FLOOR(o_totalprice)) FILTER (o_orderstatus = 'O') AS "O",
              MEDIAN(FLOOR(o_totalprice)) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def pivot_median(spark, sf_dir):
    whole = table(spark, sf_dir, "orders").withColumn("whole", F.floor("o_totalprice"))
    return pivot.pivot(whole, "o_orderpriority", "o_orderstatus", "whole", "MEDIAN")


@query(
    "pivot_median_long",
    """SELECT l_returnflag, l_linestatus, ROUND(MEDIAN(l_quantity), 2) AS value FROM lineitem GROUP BY ALL""",
)
def pivot_median_long(spark, sf_dir):
    return pivot.pivot_long(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "MEDIAN")


@query(
    "chart_bar",
    """SELECT event_type, user_id, ROUND(SUM(value), 2) AS y FROM events GROUP BY event_type, user_id""",
)
def chart_bar(spark, sf_dir):
    rows = agg.chart_data(table(spark, sf_dir, "events"), "Bar", "event_type", "value", color_by="user_id")
    return rows.withColumn("y", F.round("y", 2))


@query(
    "chart_line",
    """SELECT CAST(ts AS DATE) AS day, event_type, ROUND(SUM(value), 2) AS y FROM events GROUP BY ALL""",
)
def chart_line(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return agg.chart_data(events, "Line", "day", "value", facet_by="event_type").withColumn("y", F.round("y", 2))


@query("chart_count", "SELECT lang, COUNT(*) AS y FROM documents GROUP BY lang")
def chart_count(spark, sf_dir):
    return agg.chart_data(table(spark, sf_dir, "documents").select("lang", "source"), "Bar", "lang")


@query(
    "chart_scatter",
    "SELECT user_id, value FROM events",
)
def chart_scatter(spark, sf_dir):
    return agg.chart_data(table(spark, sf_dir, "events"), "Scatter").select("user_id", "value")


@query(
    "auto_chart_bar",
    """SELECT event_type AS x, SUM(CAST(user_id AS DOUBLE)) AS y FROM events GROUP BY event_type""",
)
def auto_chart_bar(spark, sf_dir):
    work = Workbench(spark)
    work.register("events", table(spark, sf_dir, "events"))
    work.sql("SELECT event_type, user_id, value FROM events")
    return work.auto_chart()[1]


@query(
    "auto_chart_line",
    "SELECT CAST(o_orderdate AS DATE) AS x, SUM(CAST(o_custkey AS DOUBLE)) AS y FROM orders GROUP BY 1",
)
def auto_chart_line(spark, sf_dir):
    work = Workbench(spark)
    work.register("orders", table(spark, sf_dir, "orders"))
    work.sql("SELECT CAST(o_orderdate AS DATE) AS order_date, o_custkey FROM orders")
    return work.auto_chart()[1]


@query(
    "auto_chart_frequency",
    "SELECT p_brand AS category, COUNT(*) AS count FROM part GROUP BY p_brand",
)
def auto_chart_frequency(spark, sf_dir):
    return agg.auto_chart(table(spark, sf_dir, "part").select("p_brand", "p_type"))[1]


@query(
    "saved_sum_by_category",
    "SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment",
)
def saved_sum_by_category(spark, sf_dir):
    work = Workbench(spark)
    work.register("customer", table(spark, sf_dir, "customer"))
    rows = work.saved_query("Sum by Category", category="c_mktsegment", amount="c_acctbal")
    return rows.withColumn("total", F.round("total", 2))


@query(
    "saved_missing_check",
    f"""SELECT 'all_columns' AS col, COUNT(*) AS total, COUNT(*) FILTER (amount IS NULL) AS missing FROM ({GAPS_SQL})""",
)
def saved_missing_check(spark, sf_dir):
    work = Workbench(spark)
    work.register("gaps", gaps(spark, sf_dir))
    return work.saved_query("Missing Values Check", column="amount")


@query(
    "saved_date_trend",
    "SELECT CAST(ts AS DATE) AS d, COUNT(*) AS count FROM events GROUP BY 1",
)
def saved_date_trend(spark, sf_dir):
    work = Workbench(spark)
    work.register("events", table(spark, sf_dir, "events"))
    return work.saved_query("Date Trend (Daily)", date="ts")


@query(
    "union_all_totals",
    """SELECT 'orders' AS source, COUNT(*) AS n FROM orders UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
       UNION ALL SELECT 'events', COUNT(*) FROM events""",
)
def union_all_totals(spark, sf_dir):
    parts = [
        table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        for name in ("orders", "lineitem", "events")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("saved_top_ten", "SELECT * FROM customer ORDER BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment LIMIT 10")
def saved_top_ten(spark, sf_dir):
    work = Workbench(spark)
    work.register("customer", table(spark, sf_dir, "customer"))
    return work.saved_query("Select Top 10")


@query("saved_count_by_category", "SELECT p_brand, COUNT(*) AS count FROM part GROUP BY p_brand")
def saved_count_by_category(spark, sf_dir):
    work = Workbench(spark)
    work.register("part", table(spark, sf_dir, "part"))
    return work.saved_query("Count by Category", category="p_brand")


@query(
    "saved_value_distribution",
    "SELECT l_quantity, COUNT(*) AS count FROM lineitem GROUP BY l_quantity ORDER BY count DESC, l_quantity LIMIT 20",
)
def saved_value_distribution(spark, sf_dir):
    work = Workbench(spark)
    work.register("lineitem", table(spark, sf_dir, "lineitem"))
    return work.saved_query("Value Distribution", amount="l_quantity")
