"""Time roll-ups, growth and cohorts."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import timeline

from .registry import query, table

_DAY = "CAST(o_orderdate AS DATE)"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query(
    "daily_trend",
    f"""SELECT {_DAY} AS day, COUNT(*) AS records, ROUND(SUM(o_totalprice), 2) AS daily_total FROM orders
        GROUP BY 1 ORDER BY 1""",
)
def daily_trend(spark, sf_dir):
    return timeline.daily_trend(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "daily_trend_latest",
    f"""SELECT {_DAY} AS day, COUNT(*) AS records, ROUND(SUM(o_totalprice), 2) AS daily_total FROM orders
        GROUP BY 1 ORDER BY 1 DESC""",
)
def daily_trend_latest(spark, sf_dir):
    return timeline.daily_trend(orders(spark, sf_dir), "o_orderdate", "o_totalprice", latest=True)


@query(
    "monthly_totals",
    """SELECT YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month, COUNT(*) AS records,
              ROUND(SUM(o_totalprice), 2) AS monthly_total FROM orders GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC""",
)
def monthly_totals(spark, sf_dir):
    return timeline.monthly_totals(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "day_of_week",
    """SELECT DAYNAME(o_orderdate) AS day_of_week, COUNT(*) AS record_count, ROUND(AVG(o_totalprice), 2) AS daily_avg,
              ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def day_of_week(spark, sf_dir):
    return timeline.day_of_week(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "hourly",
    """SELECT HOUR(ts) AS hour, COUNT(*) AS record_count, ROUND(SUM(value), 2) AS hourly_total FROM events GROUP BY 1""",
)
def hourly(spark, sf_dir):
    return timeline.hourly(table(spark, sf_dir, "events"), "ts", "value")


@query(
    "moving_average_7_days",
    f"""WITH d AS (SELECT {_DAY} AS day, SUM(o_totalprice) AS t FROM orders GROUP BY 1)
        SELECT day, ROUND(t, 2) AS daily_total, ROUND(AVG(t) OVER (ORDER BY day ROWS 6 PRECEDING), 2) AS moving_avg_7d
        FROM d ORDER BY day DESC""",
)
def moving_average_7_days(spark, sf_dir):
    return timeline.moving_average(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "month_over_month",
    """WITH m AS (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month, SUM(o_totalprice) AS t
                  FROM orders GROUP BY 1)
       SELECT month, ROUND(t, 2) AS current_month, ROUND(LAG(t) OVER (ORDER BY month), 2) AS previous_month,
              ROUND(100 * (t - LAG(t) OVER (ORDER BY month)) / NULLIF(LAG(t) OVER (ORDER BY month), 0), 2) AS growth_pct
       FROM m ORDER BY month DESC""",
)
def month_over_month(spark, sf_dir):
    return timeline.month_over_month(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "year_over_year",
    """WITH y AS (SELECT YEAR(o_orderdate) AS period, SUM(o_totalprice) AS t FROM orders GROUP BY 1)
       SELECT period, ROUND(t, 2) AS current_value, ROUND(LAG(t) OVER (ORDER BY period), 2) AS previous_value,
              ROUND(100 * (t - LAG(t) OVER (ORDER BY period)) / NULLIF(LAG(t) OVER (ORDER BY period), 0), 2)
                  AS growth_pct FROM y ORDER BY period DESC""",
)
def year_over_year(spark, sf_dir):
    return timeline.year_over_year(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "acquisition_cohorts",
    """WITH f AS (SELECT o_custkey, MIN(o_orderdate) AS first FROM orders GROUP BY 1)
       SELECT CAST(DATE_TRUNC('month', first) AS DATE) AS cohort_month, COUNT(DISTINCT o_custkey) AS new_users
       FROM f GROUP BY 1""",
)
def acquisition_cohorts(spark, sf_dir):
    return timeline.acquisition_cohorts(orders(spark, sf_dir), "o_custkey", "o_orderdate")


@query(
    "retention",
    """WITH f AS (SELECT o_custkey, MIN(o_orderdate) AS first FROM orders GROUP BY 1)
       SELECT CAST(DATE_TRUNC('month', first) AS DATE) AS cohort_month,
              DATE_DIFF('month', CAST(first AS DATE), CAST(o_orderdate AS DATE)) AS month_index,
              COUNT(DISTINCT o_custkey) AS active_users
       FROM orders JOIN f USING (o_custkey) GROUP BY 1, 2""",
)
def retention(spark, sf_dir):
    return timeline.retention(orders(spark, sf_dir), "o_custkey", "o_orderdate")


@query(
    "retention_shipments",
    """WITH f AS (SELECT l_suppkey, MIN(l_shipdate) AS first FROM lineitem GROUP BY 1)
       SELECT CAST(DATE_TRUNC('month', first) AS DATE) AS cohort_month,
              DATE_DIFF('month', CAST(first AS DATE), CAST(l_shipdate AS DATE)) AS month_index,
              COUNT(DISTINCT l_suppkey) AS active_users
       FROM lineitem JOIN f USING (l_suppkey) GROUP BY 1, 2""",
)
def retention_shipments(spark, sf_dir):
    return timeline.retention(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate")


@query(
    "turns_per_role",
    "SELECT role, COUNT(*) AS turns, COUNT(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role",
)
def turns_per_role(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations")
    )
