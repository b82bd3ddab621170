"""One group, key or value holding a third of the rows changes no result and fills no single task."""
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.operators import joins, ordered, quality, quantiles, timeline
from tabloom.operators.ordered import asc
from tabloom.plans.analyses import rank_in_group

ROWS = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(ROWS).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', pmod(hash(id), 500)) END AS g",
        "cast(pmod(hash(id, 7), 1000) AS double) AS v",
        "date_add(DATE '2023-01-01', cast(pmod(hash(id, 3), 400) AS int)) AS d",
    )


def test_rank_in_hot_group(skewed):
    got = rank_in_group(skewed, "g", "v", "r").select("id", "r")
    want = skewed.select("id", F.rank().over(W.partitionBy("g").orderBy(F.desc("v"))).cast("long").alias("r"))
    assert got.exceptAll(want).isEmpty() and got.count() == ROWS


def test_hot_group_fills_several_buckets(skewed):
    rows = ordered.arrange(skewed, [asc("g"), ordered.desc("v"), asc("id")], 24)
    sizes = rows.groupBy("__bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 2 * ROWS / 24


def test_one_value_of_one_group_fills_several_buckets(skewed):
    """A scan without a tie-breaker splits the peers of one (group, value) too."""
    same = skewed.withColumn("v", F.when(F.col("g") == "hot", 1.0).otherwise(F.col("v")))
    got = rank_in_group(same, "g", "v", "r").select("id", "r")
    want = same.select("id", F.rank().over(W.partitionBy("g").orderBy(F.desc("v"))).cast("long").alias("r"))
    assert got.exceptAll(want).isEmpty()
    rows = ordered.arrange(same.withColumn("t", ordered._row_hash(same)), [asc("g"), ordered.desc("v"), asc("t")], 24)
    assert rows.groupBy("__bucket").count().agg(F.max("count")).first()[0] < 2 * ROWS / 24


def test_keyed_lookup_treats_the_hot_key_apart(skewed):
    means = joins.group_average(skewed, "g", "v", "m")
    got = joins.lookup(skewed, means, ["g"], broadcast_bytes=0)
    want = joins.lookup(skewed, means, ["g"])
    assert got.select("id", F.round("m", 9)).exceptAll(want.select("id", F.round("m", 9))).isEmpty()
    assert got.count() == ROWS


def test_first_of_hot_key_is_combined_before_the_shuffle(skewed, capsys):
    first = quality.first_per_key(skewed, ["g"], [asc("id")])
    assert first.where("g = 'hot'").first()["id"] == 0
    first.explain()
    plan = capsys.readouterr().out
    assert "partial_min_by" in plan and "Window" not in plan


def test_retention_of_hot_entity(skewed):
    got = {tuple(r) for r in timeline.retention(skewed, "g", "d").collect()}
    first = skewed.groupBy("g").agg(F.min("d").alias("f"))
    months = "(year({0}) * 12 + month({0}))"
    want = (
        skewed.join(first, "g")
        .groupBy(
            F.trunc("f", "month").alias("c"),
            F.expr(f"cast({months.format('d')} - {months.format('f')} AS bigint)").alias("i"),
        )
        .agg(F.count_distinct("g"))
    )
    assert got == {tuple(r) for r in want.collect()}


def test_percentile_of_a_hot_value(spark):
    df = spark.range(ROWS).selectExpr("CASE WHEN id % 3 <> 0 THEN 500.0D ELSE cast(id AS double) END AS v")
    want = df.agg(F.percentile("v", [0.01, 0.3, 0.5, 0.99])).first()[0]
    assert quantiles.exact_quantiles(df, F.col("v"), (0.01, 0.3, 0.5, 0.99)) == pytest.approx(want)
