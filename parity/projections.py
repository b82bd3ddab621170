"""Projections, filters, derived columns and joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import Workbench
from tabloom.functions import cells, dates
from tabloom.operators import filters, joins
from tabloom.operators import timeline

from .registry import GAPS_SQL, gaps, query, table


def bench(spark, sf_dir, *names) -> Workbench:
    work = Workbench(spark)
    for name in names:
        work.register(name, table(spark, sf_dir, name))
    return work


@query(
    "sql_positional_parameters",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 250000",
)
def sql_positional(spark, sf_dir):
    text = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice >= ?"
    return bench(spark, sf_dir, "orders").sql(text, ["F", 250000])


@query(
    "sql_named_parameters",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 50000",
)
def sql_named(spark, sf_dir):
    text = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = :p AND o_totalprice < :cap"
    return bench(spark, sf_dir, "orders").sql(text, {"p": "1-URGENT", "cap": 50000})


@query("filter_where", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 500")
def filter_where(spark, sf_dir):
    return bench(spark, sf_dir, "customer").filter("c_mktsegment = ? AND c_acctbal >= 500", ["BUILDING"])


@query(
    "filtered_view",
    """SELECT o_orderpriority, COUNT(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'O')
       GROUP BY o_orderpriority""",
)
def filtered_view(spark, sf_dir):
    work = bench(spark, sf_dir, "orders")
    work.create_view("open_orders", "o_orderstatus = 'O'")
    return work.sql("SELECT o_orderpriority, COUNT(*) AS n FROM open_orders GROUP BY o_orderpriority")


@query(
    "add_column",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '/' || o_orderstatus AS label,
              CASE WHEN o_totalprice >= 100000 THEN 'large' ELSE 'small' END AS o_orderpriority FROM orders""",
)
def add_column(spark, sf_dir):
    work = bench(spark, sf_dir, "orders")
    work.add_column("label", "concat(o_custkey, '/', o_orderstatus)")
    work.add_column("o_orderpriority", "CASE WHEN o_totalprice >= ? THEN 'large' ELSE 'small' END", parameters=[100000])
    return work.sql("SELECT o_orderkey, label, o_orderpriority FROM orders")


@query(
    "tiers",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 10000 THEN 'PLATINUM' WHEN c_acctbal >= 5000 THEN 'GOLD'
                              WHEN c_acctbal >= 1000 THEN 'SILVER' ELSE 'BRONZE' END AS tier FROM customer""",
)
def tiers(spark, sf_dir):
    return filters.tiers(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "tier")


@query(
    "value_tiers",
    """SELECT l_orderkey, l_extendedprice, CASE WHEN l_extendedprice < 1000 THEN 'Low'
              WHEN l_extendedprice < 10000 THEN 'Medium' ELSE 'High' END AS value_tier FROM lineitem""",
)
def value_tiers(spark, sf_dir):
    rows = filters.value_tiers(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rows.select("l_orderkey", "l_extendedprice", "value_tier")


@query(
    "median_bands",
    f"""WITH g AS (SELECT TRY_CAST(amount AS DOUBLE) AS v FROM ({GAPS_SQL})), m AS (SELECT MEDIAN(v) AS med FROM g)
        SELECT CASE WHEN v IS NULL THEN 'Missing' WHEN v = 0 THEN 'Zero' WHEN v < med THEN 'Below Median'
                    ELSE 'Above Median' END AS category, COUNT(*) AS count FROM g, m GROUP BY 1""",
)
def median_bands(spark, sf_dir):
    return filters.median_bands(gaps(spark, sf_dir), "amount")


@query(
    "median_filter",
    """SELECT * FROM orders WHERE o_totalprice >= (SELECT CAST(FLOOR(MEDIAN(o_totalprice)) AS BIGINT) FROM orders)""",
)
def median_filter(spark, sf_dir):
    return filters.at_least_median(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "above_median",
    f"""WITH g AS (SELECT event_id, TRY_CAST(amount AS DOUBLE) AS v FROM ({GAPS_SQL}))
        SELECT event_id FROM g WHERE v > (SELECT MEDIAN(v) FROM g)""",
)
def above_median(spark, sf_dir):
    return filters.above_median(gaps(spark, sf_dir), "amount").select("event_id")


@query(
    "status_and_amount",
    "SELECT * FROM orders WHERE o_orderstatus = 'P' AND TRY_CAST(o_totalprice AS DOUBLE) >= 500",
)
def status_and_amount(spark, sf_dir):
    return filters.status_and_amount(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "P")


@query(
    "high_values",
    "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 10000",
)
def high_values(spark, sf_dir):
    rows = filters.high_values(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rows.select("l_orderkey", "l_extendedprice")


@query(
    "above_average",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
       WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)""",
)
def above_average(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return joins.above_average(orders, "o_totalprice", ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query(
    "above_average_subquery",
    """SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)""",
)
def above_average_subquery(spark, sf_dir):
    text = "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)"
    return bench(spark, sf_dir, "part").sql(text)


@query(
    "arithmetic_projection",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity AS total FROM lineitem",
)
def arithmetic(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice * l_quantity AS total"
    )


@query("date_filter", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'")
def date_filter(spark, sf_dir):
    return bench(spark, sf_dir, "orders").filter("o_orderdate >= '2000-06-01'")


@query(
    "like_filters",
    """SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%' AND p_type NOT LIKE 'ECONOMY'""",
)
def like_filters(spark, sf_dir):
    return bench(spark, sf_dir, "part").sql(
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%' AND p_type NOT LIKE 'ECONOMY'"
    )


@query(
    "date_features",
    """SELECT o_orderkey, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month, DAYNAME(o_orderdate) AS day_of_week,
              ISODOW(o_orderdate) >= 6 AS is_weekend FROM orders""",
)
def date_features(spark, sf_dir):
    rows = filters.with_date_features(table(spark, sf_dir, "orders"), "o_orderdate")
    return rows.select("o_orderkey", "year", "month", "day_of_week", "is_weekend")


@query(
    "date_features_from_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, YEAR(l_shipdate) AS year, MONTH(l_shipdate) AS month,
              DAYNAME(l_shipdate) AS day_of_week, ISODOW(l_shipdate) >= 6 AS is_weekend
       FROM lineitem WHERE l_returnflag <> 'A'""",
)
def date_features_from_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "shipped", F.expr("CASE WHEN l_returnflag = 'A' THEN 'unknown' ELSE date_format(l_shipdate, 'yyyy-MM-dd') END")
    )
    rows = filters.with_date_features(lines, "shipped")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "year", "month", "day_of_week", "is_weekend")


@query(
    "text_features",
    "SELECT p_partkey, p_name, UPPER(p_name) AS p_name_upper, LENGTH(p_name) AS p_name_length FROM part",
)
def text_features(spark, sf_dir):
    rows = filters.with_text_features(table(spark, sf_dir, "part"), "p_name")
    return rows.select("p_partkey", "p_name", "p_name_upper", "p_name_length")


@query(
    "text_features_documents",
    "SELECT doc_id, LENGTH(text) AS text_length, MD5(UPPER(lang)) AS lang_key FROM documents",
)
def text_features_documents(spark, sf_dir):
    rows = filters.with_text_features(table(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", "text_length", F.md5(F.upper("lang")).alias("lang_key"))


@query("number_coercion", f"SELECT event_id, TRY_CAST(amount AS DOUBLE) AS amount FROM ({GAPS_SQL})")
def number_coercion(spark, sf_dir):
    return filters.with_number(gaps(spark, sf_dir), "amount").select("event_id", "amount")


@query(
    "calendar_functions",
    """SELECT o_orderkey, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start,
              CAST(DATE_TRUNC('day', o_orderdate) AS DATE) AS day_start,
              DATE_DIFF('month', DATE '1995-01-31', CAST(o_orderdate AS DATE)) AS months_since,
              CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS BIGINT) AS days_to_2002,
              DAYNAME(o_orderdate) AS day_name FROM orders""",
)
def calendar_functions(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.month(at).alias("month_start"),
        dates.day(at).alias("day_start"),
        dates.months_between(F.lit("1995-01-31"), at).alias("months_since"),
        F.datediff(F.lit("2002-01-01").cast("date"), at).cast("long").alias("days_to_2002"),
        dates.day_name(at).alias("day_name"),
    )


@query(
    "null_handling",
    f"""SELECT event_id, COALESCE(kind, 'none') AS kind, NULLIF(amount, '') AS amount,
               amount IS NOT DISTINCT FROM NULL AS missing,
               REGEXP_FULL_MATCH(COALESCE(amount, ''), '[0-9]*\\.?[0-9]+') AS numeric FROM ({GAPS_SQL})""",
)
def null_handling(spark, sf_dir):
    amount = F.col("amount")
    return gaps(spark, sf_dir).select(
        "event_id",
        F.coalesce("kind", F.lit("none")).alias("kind"),
        F.nullif(amount, F.lit("")).alias("amount"),
        amount.eqNullSafe(F.lit(None)).alias("missing"),
        cells.looks_numeric(F.coalesce(amount, F.lit(""))).alias("numeric"),
    )


@query(
    "join_inner",
    """SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def join_inner(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = joins.inner_join(joins.inner_join(orders, customer, "o_custkey", "c_custkey"), nation, "c_nationkey", "n_nationkey")
    return joined.select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query(
    "join_loaded_tables",
    """SELECT s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def join_loaded(spark, sf_dir):
    return bench(spark, sf_dir, "supplier", "nation").sql(
        "SELECT s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    )


@query(
    "join_group_average",
    """WITH m AS (SELECT o_orderstatus, AVG(o_totalprice) AS a FROM orders GROUP BY o_orderstatus)
       SELECT o_orderkey, ROUND(a, 6) AS category_avg, ROUND(o_totalprice - a, 6) AS diff_from_avg
       FROM orders JOIN m USING (o_orderstatus)""",
)
def join_group_average(spark, sf_dir):
    rows = joins.join_group_average(
        table(spark, sf_dir, "orders"),
        "o_orderstatus",
        "o_totalprice",
        how="inner",
        mean_name="category_avg",
        diff_name="diff_from_avg",
    )
    return rows.select("o_orderkey", F.round("category_avg", 6).alias("category_avg"), F.round("diff_from_avg", 6).alias("diff_from_avg"))


@query(
    "left_join_group_mean",
    f"""WITH g AS (SELECT event_id, kind, TRY_CAST(amount AS DOUBLE) AS v FROM ({GAPS_SQL})),
             m AS (SELECT kind, AVG(v) AS a FROM g WHERE kind IS NOT NULL GROUP BY kind)
        SELECT event_id, g.kind, ROUND(a, 6) AS avg_value FROM g LEFT JOIN m ON g.kind = m.kind""",
)
def left_join_group_mean(spark, sf_dir):
    rows = joins.join_group_average(gaps(spark, sf_dir), "kind", "amount", mean_name="avg_value", diff_name=None)
    return rows.select("event_id", "kind", F.round("avg_value", 6).alias("avg_value"))


@query(
    "activity_with_first_seen",
    """SELECT o_orderkey, o_custkey, o_orderdate, MIN(o_orderdate) OVER (PARTITION BY o_custkey) AS acquisition_date
       FROM orders""",
)
def activity_with_first_seen(spark, sf_dir):
    rows = timeline.activity_with_first_seen(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "acquisition_date")


@query(
    "join_full_outer",
    """SELECT COALESCE(o.k, e.k) AS k, COALESCE(orders, 0) AS orders, COALESCE(events, 0) AS events,
              CASE WHEN o.k IS NULL THEN 0 ELSE 1 END AS in_orders, CASE WHEN e.k IS NULL THEN 0 ELSE 1 END AS in_events
       FROM (SELECT o_custkey AS k, COUNT(*) AS orders FROM orders GROUP BY 1) o
       FULL OUTER JOIN (SELECT user_id AS k, COUNT(*) AS events FROM events GROUP BY 1) e ON o.k = e.k""",
)
def join_full_outer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("events"))
    joined = orders.withColumn("in_orders", F.lit(1)).join(events.withColumn("in_events", F.lit(1)), "k", "full_outer")
    return joined.fillna(0)


@query(
    "scalar_subquery_columns",
    """SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS total, (SELECT COUNT(*) FROM customer) AS customers
       FROM customer GROUP BY c_mktsegment""",
)
def scalar_subquery(spark, sf_dir):
    return bench(spark, sf_dir, "customer").sql(
        """SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS total, (SELECT COUNT(*) FROM customer) AS customers
           FROM customer GROUP BY c_mktsegment"""
    )
