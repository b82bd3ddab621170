import pytest
from pyspark.sql import functions as F

from tabloom.operators import quantiles

PROBABILITIES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize("shape", ["id", "id % 2", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END", "7", "pow(1.001, id)"])
def test_equals_builtin(spark, shape):
    df = spark.range(5000).selectExpr(f"CASE WHEN id % 17 <> 0 THEN cast({shape} AS double) END AS v")
    want = df.agg(F.percentile("v", list(PROBABILITIES))).first()[0]
    assert quantiles.exact_quantiles(df, F.col("v"), PROBABILITIES) == pytest.approx(want, rel=1e-12)


def test_several_columns_share_the_passes(spark):
    df = spark.range(3000).selectExpr("id AS a", "cast(NULL AS int) AS b", "id % 5 AS c", "if(id % 2 = 0, double('NaN'), id) AS d")
    got = quantiles.exact_quantiles_of(df, {c: F.col(c) for c in "abcd"}, (0.5, 1.0))
    assert got == {"a": [1499.5, 2999.0], "b": [None, None], "c": [2.0, 4.0], "d": [1500.0, 2999.0]}


def test_empty(spark):
    df = spark.range(3).selectExpr("cast(NULL AS double) AS v")
    assert quantiles.exact_quantiles(df, F.col("v"), (0.5,)) == [None]
    assert quantiles.exact_quantiles(df.limit(0), F.col("v"), (0.5,)) == [None]


def test_grouped_medians_of_a_hot_group(spark):
    df = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('g', id % 40) END AS g", "pmod(hash(id), 1000) AS v"
    )
    got = quantiles.grouped_medians(df, ["g"], F.col("v"))
    assert got.exceptAll(df.groupBy("g").agg(F.median("v"))).isEmpty() and got.count() == df.select("g").distinct().count()


def test_keys_follow_the_order_of_doubles(spark):
    import math
    import struct

    edge = [2.0**e * f for e in (-1074, -1073, -1023, -1022, -1021, -1, 0, 1, 3, 52, 53, 300, 1022, 1023) for f in (1.0, 1.0 + 2**-52, 1.5, 2.0 - 2**-52)]
    some = [x for v in [*edge, 0.0, 1e-310, 1.1, 1e9, 123456.789] if math.isfinite(v) for x in (v, -v)] + [math.inf, -math.inf]
    df = spark.createDataFrame([(x,) for x in [*some, None, math.nan]], "v double")
    found = quantiles.ordered_keys(df, {"k": F.col("v")}, F.col("v")).select("__rest0", "k", quantiles._value(F.col("k"))).collect()
    for value, key, back in found:
        if value is None or math.isnan(value):
            assert key is None
            continue
        bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
        assert key == (bits if value > 0 else -bits) and back == value and quantiles.key_of(value) == key
    assert len(found) == len(some) + 2


def test_passes_do_not_follow_the_rows(spark, monkeypatch):
    """Values of every magnitude are told apart in at most eight passes of bins."""
    passes = []
    plain = quantiles._bins
    monkeypatch.setattr(quantiles, "_bins", lambda *a: passes.append(1) or plain(*a))
    df = spark.range(20000).selectExpr("if(id % 3 = 0, 1e300, pow(1.03, id)) * if(id % 2 = 0, -1, 1) AS v", "cast(id AS double) AS w")
    want = df.agg(F.percentile("v", [0.1, 0.5, 0.9]), F.percentile("w", [0.1, 0.5, 0.9])).first()
    got = quantiles.exact_quantiles_of(df, {"v": F.col("v"), "w": F.col("w")}, (0.1, 0.5, 0.9))
    assert got["v"] == pytest.approx(want[0]) and got["w"] == pytest.approx(want[1])
    assert len(passes) <= 8


def test_intervals_joined_by_key_give_the_same_medians(spark, monkeypatch):
    df = spark.range(6000).selectExpr("if(id % 2 = 0, 'hot', concat('g', id % 900)) AS g", "if(id % 5 = 0, NULL, id % 3) AS h", "sqrt(pmod(hash(id), 100000)) - 100 AS v")
    want = {(r[0], r[1]): r[2] for r in df.groupBy("g", "h").agg(F.median("v")).collect()}
    for limit in (quantiles.BROADCAST_BYTES, 0):
        monkeypatch.setattr(quantiles, "BROADCAST_BYTES", limit)
        got = {(r[0], r[1]): r[2] for r in quantiles.grouped_medians(df, ["g", "h"], F.col("v")).collect()}
        assert got == pytest.approx(want)
