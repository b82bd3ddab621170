"""Global and per-group window functions, through the bucketed ordered scan."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import joins, ordered
from tabloom.operators.ordered import asc, desc
from tabloom.plans import analyses

from .registry import GAPS_SQL, TIES_SQL, gaps, query, table, ties


def exact_events(spark, sf_dir):
    """Events with the value as an exact decimal, so that sums do not depend on their order."""
    return table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))


@query(
    "running_total",
    """SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY ts, event_id
              ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM events""",
)
def running_total(spark, sf_dir):
    rows = ordered.scan(
        exact_events(spark, sf_dir), [asc("ts")], {"running_total": ordered.running_sum("value")}, tie=[asc("event_id")]
    )
    return rows.select("event_id", F.col("running_total").cast("double").alias("running_total"))


@query(
    "moving_average_3",
    """SELECT event_id, ROUND(AVG(value) OVER (ORDER BY ts, event_id ROWS 2 PRECEDING), 4) AS moving_avg_3_period
       FROM events""",
)
def moving_average_3(spark, sf_dir):
    rows = ordered.scan(
        table(spark, sf_dir, "events"),
        [asc("ts")],
        {"moving_avg_3_period": ordered.moving_avg("value", 3)},
        tie=[asc("event_id")],
    )
    return rows.select("event_id", F.round("moving_avg_3_period", 4).alias("moving_avg_3_period"))


@query(
    "lag_difference",
    """SELECT event_id, LAG(value) OVER (ORDER BY ts, event_id) AS prev_amount,
              value - LAG(value) OVER (ORDER BY ts, event_id) AS growth FROM events""",
)
def lag_difference(spark, sf_dir):
    rows = ordered.scan(
        table(spark, sf_dir, "events"), [asc("ts")], {"prev_amount": ordered.lag("value")}, tie=[asc("event_id")]
    )
    return rows.select("event_id", "prev_amount", (F.col("value") - F.col("prev_amount")).alias("growth"))


@query(
    "ranks",
    f"""SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY price DESC, o_orderkey) AS row_num,
               RANK() OVER (ORDER BY price DESC) AS rank_amount,
               DENSE_RANK() OVER (ORDER BY price DESC) AS dense_rank_amount FROM ({TIES_SQL})""",
)
def ranks(spark, sf_dir):
    rows = ordered.scan(
        ties(spark, sf_dir),
        [desc("price")],
        {"row_num": ordered.row_number(), "rank_amount": ordered.rank(), "dense_rank_amount": ordered.dense_rank()},
        tie=[asc("o_orderkey")],
    )
    return rows.select("o_orderkey", "row_num", "rank_amount", "dense_rank_amount")


@query(
    "ranks_with_nulls",
    f"""WITH g AS (SELECT event_id, TRY_CAST(amount AS DOUBLE) AS v FROM ({GAPS_SQL}))
        SELECT event_id, RANK() OVER (ORDER BY v NULLS LAST) AS r, DENSE_RANK() OVER (ORDER BY v NULLS LAST) AS d,
               PERCENT_RANK() OVER (ORDER BY v NULLS LAST) AS p,
               CAST(NTILE(7) OVER (ORDER BY v NULLS LAST, event_id) AS BIGINT) AS tile FROM g""",
)
def ranks_with_nulls(spark, sf_dir):
    rows = gaps(spark, sf_dir).select("event_id", F.expr("try_cast(amount as double)").alias("v"))
    outputs = {
        "r": ordered.rank(),
        "d": ordered.dense_rank(),
        "p": ordered.percent_rank(),
        "tile": ordered.ntile(7),
    }
    return ordered.scan(rows, [asc("v")], outputs, tie=[asc("event_id")]).drop("v")


@query(
    "rank_one_heavy_value",
    """WITH g AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE FLOOR(value) END AS v FROM events)
       SELECT event_id, RANK() OVER (ORDER BY v) AS r, DENSE_RANK() OVER (ORDER BY v) AS d,
              SUM(CAST(v AS BIGINT)) OVER (ORDER BY v)::BIGINT AS upto FROM g""",
)
def rank_one_heavy_value(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_type = 'view' THEN 0 ELSE cast(floor(value) as bigint) END AS v"
    )
    outputs = {"r": ordered.rank(), "d": ordered.dense_rank(), "upto": ordered.running_sum_peers("v")}
    return ordered.scan(rows, [asc("v")], outputs, tie=[asc("event_id")]).drop("v")


@query(
    "running_total_text_order",
    """SELECT doc_id, CAST(SUM(n_chars) OVER (ORDER BY source, lang, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars,
              ROW_NUMBER() OVER (ORDER BY source, lang, doc_id) AS position FROM documents""",
)
def running_total_text_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    outputs = {"chars": ordered.running_sum("n_chars"), "position": ordered.row_number()}
    return ordered.scan(rows, [asc("source"), asc("lang")], outputs, tie=[asc("doc_id")]).select(
        "doc_id", "chars", "position"
    )


@query(
    "rank_in_group",
    f"""SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY price DESC) AS rank_in_status
        FROM ({TIES_SQL})""",
)
def rank_in_group(spark, sf_dir):
    rows = analyses.rank_in_group(ties(spark, sf_dir), "o_orderstatus", "price", "rank_in_status")
    return rows.select("o_orderkey", "rank_in_status")


@query(
    "group_mean_difference",
    """SELECT c_custkey, ROUND(AVG(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS group_mean,
              ROUND(c_acctbal - AVG(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS diff_from_group_mean
       FROM customer""",
)
def group_mean_difference(spark, sf_dir):
    rows = joins.join_group_average(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return rows.select(
        "c_custkey",
        F.round("group_mean", 6).alias("group_mean"),
        F.round("diff_from_group_mean", 6).alias("diff_from_group_mean"),
    )


@query(
    "rolling_3",
    f"""WITH g AS (SELECT event_id, ts, TRY_CAST(amount AS DOUBLE) AS v FROM ({GAPS_SQL}))
        SELECT event_id, ROUND(AVG(v) OVER (ORDER BY ts, event_id ROWS 2 PRECEDING), 4) AS rolling_3_avg,
               ROUND(SUM(v) OVER (ORDER BY ts, event_id ROWS 2 PRECEDING), 2) AS rolling_3_sum FROM g""",
)
def rolling_3(spark, sf_dir):
    rows = analyses.rolling(gaps(spark, sf_dir), "ts", "amount", "event_id")
    return rows.select(
        "event_id", F.round("rolling_3_avg", 4).alias("rolling_3_avg"), F.round("rolling_3_sum", 2).alias("rolling_3_sum")
    )


@query(
    "average_rank",
    f"""WITH t AS ({TIES_SQL}), c AS (SELECT o_orderkey, RANK() OVER (ORDER BY price DESC) AS rd,
               RANK() OVER (ORDER BY price) AS ra, COUNT(*) OVER (PARTITION BY price) AS n, COUNT(*) OVER () AS total
        FROM t)
        SELECT o_orderkey, rd + (n - 1) / 2.0::DOUBLE AS rank, (ra + (n - 1) / 2.0::DOUBLE) / total AS percentile FROM c""",
)
def average_rank(spark, sf_dir):
    return analyses.value_ranking(ties(spark, sf_dir), "price").select("o_orderkey", "rank", "percentile")


@query(
    "average_rank_scan",
    f"""SELECT o_orderkey, RANK() OVER (ORDER BY price DESC) + (COUNT(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE
               AS rank FROM ({TIES_SQL})""",
)
def average_rank_scan(spark, sf_dir):
    rows = ordered.scan(
        ties(spark, sf_dir), [desc("price")], {"rank": ordered.average_rank()}, tie=[asc("o_orderkey")]
    )
    return rows.select("o_orderkey", "rank")
