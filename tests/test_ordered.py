"""The bucketed scan equals the plain window for any number of buckets, with ties, NULLs and a hot value."""
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.operators import ordered as o
from tabloom.plans.analyses import rank_in_group, value_ranking

OUTPUTS = {
    "rn": o.row_number(),
    "n": o.row_count(),
    "rank": o.rank(),
    "dense": o.dense_rank(),
    "pct": o.percent_rank(),
    "avg": o.average_rank(),
    "tile": o.ntile(7),
    "run": o.running_sum("v"),
    "peers": o.running_sum_peers("v"),
    "lag2": o.lag("v", 2),
    "mean3": o.moving_avg("v", 3),
    "sum5": o.moving_sum("v", 5),
}


def rows(spark, tiny):
    """A third of the rows share one key; some keys and values are NULL."""
    return spark.read.parquet(f"{tiny}/orders.parquet").selectExpr(
        "o_orderkey AS id",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 7000.0D ELSE round(o_totalprice, -4) END AS k",
        "CASE WHEN o_orderkey % 11 <> 0 THEN cast(o_totalprice AS decimal(18,2)) END AS v",
    )


def plain(df, key):
    peer, full = W.orderBy(key), W.orderBy(key, "id")
    return df.select(
        "id",
        F.row_number().over(full).alias("rn"),
        F.count("*").over(W.partitionBy()).alias("n"),
        F.rank().over(peer).alias("rank"),
        F.dense_rank().over(peer).alias("dense"),
        F.percent_rank().over(peer).alias("pct"),
        (F.rank().over(peer) + (F.count("*").over(W.partitionBy("k")) - 1) / 2).alias("avg"),
        F.ntile(7).over(full).alias("tile"),
        F.sum("v").over(full.rowsBetween(W.unboundedPreceding, 0)).alias("run"),
        F.sum("v").over(peer).alias("peers"),
        F.lag("v", 2).over(full).alias("lag2"),
        F.avg("v").over(full.rowsBetween(-2, 0)).alias("mean3"),
        F.sum("v").over(full.rowsBetween(-4, 0)).alias("sum5"),
    )


def collected(df):
    cast = [F.col(c).cast("double").alias(c) for c in df.columns]
    return {r["id"]: r for r in df.select(*cast).collect()}


@pytest.mark.parametrize("buckets", [1, 2, 8, 64])
@pytest.mark.parametrize("descending", [True, False])
def test_equals_plain_window(spark, tiny, buckets, descending):
    df = rows(spark, tiny)
    key = F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_last()
    got = o.scan(df, [o.Key("k", descending)], OUTPUTS, tie=[o.asc("id")], buckets=buckets)
    got, want = collected(got.select("id", *OUTPUTS)), collected(plain(df, key))
    assert got.keys() == want.keys()
    for i, row in want.items():
        for name in OUTPUTS:
            assert got[i][name] == pytest.approx(row[name]) if row[name] is not None else got[i][name] is None, (i, name)


def test_all_rows_one_key(spark):
    df = spark.range(1000).selectExpr("id", "1 AS k", "1L AS v")
    got = o.scan(df, [o.asc("k")], OUTPUTS, tie=[o.asc("id")], buckets=16)
    row = got.agg(
        F.max("rank").alias("rank"), F.max("dense").alias("dense"), F.min("peers").alias("peers"),
        F.min("avg").alias("avg"), F.max("rn").alias("rn"), F.count_distinct("rn").alias("numbers"),
    ).first()
    assert tuple(row) == (1, 1, 1000, 500.5, 1000, 1000)


def test_hot_key_is_spread(spark):
    """A key holding all rows still fills many buckets."""
    df = spark.range(10_000).selectExpr("id", "1 AS k")
    sizes = [r["n"] for r in o.arrange(df, [o.asc("k"), o.asc("id")], 16).groupBy("__bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2000


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_few_rows(spark, rows):
    df = spark.range(rows).selectExpr("id", "id AS k", "id AS v")
    got = o.scan(df, [o.asc("k")], OUTPUTS, tie=[o.asc("id")]).collect()
    assert sorted(r["rn"] for r in got) == list(range(1, rows + 1))
    assert all(r["pct"] == (0.0 if rows == 1 else (r["rn"] - 1) / (rows - 1)) for r in got)


def test_many_buckets_plan_quickly(spark):
    """The plan does not grow with the buckets, and a scan without a tie-breaker brings its own."""
    df = spark.range(20_000).selectExpr("id", "id % 50 AS k")
    o.arrange(df.limit(1), [o.asc("k")], 4096)  # the files of the write are not what is timed
    rows = o.arrange(df, [o.asc("k"), o.asc("id")], 4096)
    began = time.perf_counter()
    plan = rows.groupBy("__bucket").count()._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 2 and len(plan) < 20_000
    got = o.scan(df, [o.asc("k")], {"rn": o.row_number(), "rank": o.rank()}, buckets=32)
    assert got.select("rn").distinct().count() == 20_000
    assert got.where("rank <> k * 400 + 1").isEmpty()


def test_order_types(spark):
    """Dates, zoned times and text are valid sort keys; their order is kept."""
    df = spark.range(500).selectExpr(
        "id",
        "date_add(DATE '2024-01-01', cast(pmod(hash(id), 90) AS int)) AS d",
        "timestamp_seconds(1711800000 + id * 60) AS t",
        "cast(pmod(hash(id), 37) AS string) AS s",
    )
    for name in ("d", "t", "s"):
        got = o.scan(df, [o.desc(name)], {"rn": o.row_number()}, tie=[o.asc("id")], buckets=9)
        want = df.withColumn("rn", F.row_number().over(W.orderBy(F.desc(name), "id")))
        assert got.select("id", "rn").exceptAll(want.select("id", "rn")).isEmpty()


def test_no_single_partition_over_rows(spark, tiny, capsys):
    df = spark.read.parquet(f"{tiny}/events.parquet")
    scanned = o.scan(df, [o.asc("ts")], {"total": o.running_sum("value")}, tie=[o.asc("event_id")], buckets=4)
    scanned.explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # The only single-partition exchange feeds the per-bucket offsets, under the broadcast.
    rows_side = plan[: plan.index("BroadcastExchange")]
    assert "SinglePartition" not in rows_side


def test_rank_in_group(spark):
    df = spark.createDataFrame(
        [(1, "a", 5.0), (2, "a", 7.0), (3, "a", 7.0), (4, None, 1.0), (5, "b", None), (6, "b", 2.0)],
        "id int, g string, v double",
    )
    got = {r["id"]: r["rank_in_g"] for r in rank_in_group(df, "g", "v").collect()}
    assert got == {1: 3, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1}


def test_value_ranking(spark):
    df = spark.createDataFrame([(1, "10"), (2, "30"), (3, "10"), (4, "x"), (5, None)], "id int, v string")
    got = {r["id"]: (r["rank"], r["percentile"]) for r in value_ranking(df, "v").collect()}
    assert got[2] == (1.0, 1.0) and got[1] == got[3] == (2.5, 0.5)
    assert got[4] == got[5] == (None, None)
