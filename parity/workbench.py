"""The named analyses, run through the table API."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import Workbench

from .registry import query, table

SALES_COLUMNS = """o_orderkey AS id, o_custkey AS customer, o_orderpriority AS region,
    CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE o_orderstatus END AS status,
    CAST(o_totalprice AS DOUBLE) AS amount, CAST(o_orderdate AS DATE) AS timestamp"""
SALES = f"WITH s AS (SELECT {SALES_COLUMNS} FROM orders)"


def sales(spark, sf_dir) -> Workbench:
    work = Workbench(spark)
    orders = spark.sql(f"SELECT {SALES_COLUMNS} FROM {{source}}", source=table(spark, sf_dir, "orders"))
    work.register("sales", orders)
    return work


def result(spark, sf_dir, analysis: str, kind: str, **roles: str):
    return sales(spark, sf_dir).run(analysis, **roles)[analysis][kind]


@query("run_basic_patterns", SALES + " SELECT region, COUNT(*) AS count, ROUND(SUM(amount), 2) AS sum_amount FROM s GROUP BY region")
def run_basic_patterns(spark, sf_dir):
    return result(spark, sf_dir, "basic_patterns", "by_category")


@query(
    "run_time_analysis",
    SALES + """ SELECT YEAR(timestamp) AS year, MONTH(timestamp) AS month, COUNT(*) AS records, ROUND(SUM(amount), 2) AS monthly_total
               FROM s GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 12""",
)
def run_time_analysis(spark, sf_dir):
    return result(spark, sf_dir, "time_analysis", "monthly")


@query(
    "run_data_quality",
    SALES + """ SELECT customer AS value, COUNT(*) AS count, ROUND(100 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS percentage
               FROM s GROUP BY customer ORDER BY count DESC, customer LIMIT 5""",
)
def run_data_quality(spark, sf_dir):
    return result(spark, sf_dir, "data_quality", "top_values_customer")


@query(
    "run_business_metrics",
    SALES + """, t AS (SELECT customer, SUM(amount) AS total FROM s GROUP BY 1), g AS (SELECT SUM(total) AS grand FROM t),
              r AS (SELECT total, ROW_NUMBER() OVER (ORDER BY total DESC, customer) AS rank FROM t)
       SELECT 'Top ' || k AS metric, ROUND(SUM(total) / MAX(grand) * 100, 2) AS concentration_pct
       FROM r, g, (VALUES (3), (10), (25)) v(k) WHERE rank <= k GROUP BY k""",
)
def run_business_metrics(spark, sf_dir):
    return result(spark, sf_dir, "business_metrics", "concentration")


@query(
    "run_advanced_sql_patterns",
    SALES + """ SELECT *, ROW_NUMBER() OVER (ORDER BY amount DESC, id) AS row_num, RANK() OVER (ORDER BY amount DESC) AS rank_amount,
               DENSE_RANK() OVER (ORDER BY amount DESC) AS dense_rank_amount FROM s""",
)
def run_advanced_sql_patterns(spark, sf_dir):
    return result(spark, sf_dir, "advanced_sql_patterns", "ranks", tie="id")


@query(
    "run_sql_cohort_funnel",
    SALES + """, f AS (SELECT customer, MIN(timestamp) AS first FROM s GROUP BY 1)
       SELECT CAST(DATE_TRUNC('month', first) AS DATE) AS cohort_month, COUNT(DISTINCT customer) AS new_users FROM f GROUP BY 1""",
)
def run_sql_cohort_funnel(spark, sf_dir):
    return result(spark, sf_dir, "sql_cohort_funnel", "cohorts", entity="customer")


@query(
    "run_python_patterns",
    SALES + """, m AS (SELECT MEDIAN(amount) AS median FROM s)
       SELECT CASE WHEN amount IS NULL THEN 'Missing' WHEN amount = 0 THEN 'Zero' WHEN amount < median THEN 'Below Median'
                   ELSE 'Above Median' END AS category, COUNT(*) AS count FROM s, m GROUP BY 1""",
)
def run_python_patterns(spark, sf_dir):
    return result(spark, sf_dir, "python_patterns", "bands", amount="amount")


@query(
    "run_python_advanced_analytics",
    SALES + """ SELECT status, COUNT(*) AS count_rows, ROUND(SUM(amount), 2) AS sum_values, ROUND(AVG(amount), 2) AS mean_values,
               MAX(amount) AS max_value, 100.0::DOUBLE AS percent_positive FROM s GROUP BY status""",
)
def run_python_advanced_analytics(spark, sf_dir):
    rows = result(spark, sf_dir, "python_advanced_analytics", "group_metrics", amount="amount", category="status", date="timestamp", tie="id")
    return rows.withColumns({c: F.round(c, 2) for c in ("sum_values", "mean_values")})


@query("run_python_ml_prep", SALES + " SELECT id, customer, region, status, amount, timestamp FROM s")
def run_python_ml_prep(spark, sf_dir):
    rows = result(spark, sf_dir, "python_ml_prep", "imputed")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("id", "customer")})


@query("run_sample_data_demo", SALES + " SELECT region, COUNT(*) AS count, ROUND(SUM(amount), 2) AS sum_amount FROM s GROUP BY region")
def run_sample_data_demo(spark, sf_dir):
    return result(spark, sf_dir, "sample_data_demo", "by_region")


@query(
    "run_sample_data_sql_examples",
    SALES + """ SELECT region, COUNT(*) AS count, ROUND(SUM(amount), 2) AS total_amount, ROUND(AVG(amount), 2) AS avg_amount
               FROM s GROUP BY region""",
)
def run_sample_data_sql_examples(spark, sf_dir):
    return result(spark, sf_dir, "sample_data_sql_examples", "by_region")


@query("run_chained_with_roles", SALES + " SELECT status, COUNT(*) AS count, ROUND(SUM(amount), 2) AS sum_amount FROM s GROUP BY status")
def run_chained_with_roles(spark, sf_dir):
    results = sales(spark, sf_dir).run("python_patterns", "basic_patterns", amount="amount", category="status")
    assert "group_summary" in results["python_patterns"]
    return results["basic_patterns"]["by_category"]
