import functools

import pytest
from pyspark.sql import functions as F

from tabloom import Plan, Workbench
from tabloom.operators import aggregate as agg
from tabloom.operators import features, filters, joins, pivot, profile, quality
from tabloom.plans import analyses

SALES = [
    (1, "active", "5000", "North", "2024-01-15"),
    (2, "inactive", "3000", "South", "2024-01-16"),
    (3, "active", "12000", "East", "2024-01-17"),
    (4, "active", "800", "North", "2024-01-18"),
    (5, None, "", "West", "2024-02-19"),
    (6, "active", None, None, "2024-02-20"),
    (7, "inactive", "abc", "East", "2024-02-21"),
]


@pytest.fixture
def work(spark):
    made = Workbench(spark)
    rows = [(*r, i + 1) for i, r in enumerate(SALES)]
    made.register(
        "sales", spark.createDataFrame(rows, "id int, status string, amount string, region string, timestamp string, _row long")
    )
    return made


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def test_aggregate_skips_blank(work):
    got = as_dicts(work.aggregate("region", "amount"))
    assert got[0] == {"region": "East", "count": 2, "sum_amount": 12000.0}
    assert {r["region"]: (r["count"], r["sum_amount"]) for r in got} == {
        "East": (2, 12000.0), "North": (2, 5800.0), "South": (1, 3000.0)
    }
    assert work.last_action == "Aggregate"
    with pytest.raises(ValueError, match="unsupported aggregate"):
        work.aggregate("region", "amount", "DROP")


def test_coverage(work):
    got = {r["column"]: (r["present"], r["coverage_%"]) for r in work.coverage().collect()}
    assert got == {
        "id": (7, 100.0), "status": (6, 85.7), "amount": (5, 71.4), "region": (6, 85.7), "timestamp": (7, 100.0)
    }
    assert {r["column"] for r in profile.low_coverage(work.frame()).collect()} == {"status", "amount", "region"}


def test_coverage_of_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert [(r["present"], r["coverage_%"]) for r in profile.coverage(empty).collect()] == [(0, 0.0), (0, 0.0)]


def test_pivot_keeps_null_rows_and_zero_counts(work):
    got = {r["region"]: (r["active"], r["inactive"]) for r in work.pivot("region", "status", "amount", "COUNT").collect()}
    assert got == {"East": (1, 0), "North": (2, 0), "South": (0, 1), "West": (0, 0), None: (0, 0)}


def test_pivot_limits_levels(work):
    with pytest.raises(ValueError, match="long form"):
        pivot.pivot(work.frame(), "region", "id", "amount", max_levels=3)
    empty = work.frame().where("false")
    assert pivot.pivot(empty, "region", "status", "amount").columns == ["region"]


def test_add_column_replaces_and_moves_to_end(work):
    work.add_column("status", "upper(status)")
    assert work.columns == ["id", "amount", "region", "timestamp", "status"]
    assert work.filter("status = ?", ["ACTIVE"]).count() == 4
    work.add_column("big", "cast(id AS int) > :n", parameters={"n": 5})
    assert dict(work.frame().dtypes)["big"] == "string"


def test_views_and_tables(work, spark):
    work.create_view("north", "region = 'North'")
    assert work.sql("SELECT count(*) AS n FROM north").first()["n"] == 2
    assert work.last_query.startswith("SELECT count")
    work.register("other", spark.range(3))
    assert work.get_tables() == ["sales", "other"]
    work.set_active_table("other")
    assert work.columns == ["id"]
    with pytest.raises(ValueError):
        work.set_active_table("missing")
    work.unregister("other")
    assert work.get_tables() == ["sales"]


def test_numbers(spark):
    cases = {"1_000": 1000.0, "1d": None, "2.5F": None, " 7 ": 7.0, "1e3": 1000.0, "": None, "x": None, "-4": -4.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["v"] for r in df.select("s", profile.number(df, "s").alias("v")).collect()} == cases


def test_median_and_tiers(work):
    assert filters.median_of(work.frame(), "amount") == 4000.0
    bands = {r["category"]: r["count"] for r in filters.median_bands(work.frame(), "amount").collect()}
    assert bands == {"Missing": 3, "Below Median": 2, "Above Median": 2}
    tiers = {r["id"]: r["tier"] for r in filters.tiers(work.frame(), "amount").collect()}
    assert tiers[3] == "PLATINUM" and tiers[1] == "GOLD" and tiers[4] == tiers[6] == tiers[7] == "BRONZE"
    assert {r["id"] for r in filters.at_least_median(work.frame(), "amount").collect()} == {1, 3}


def test_share_and_values(work):
    rows = as_dicts(agg.share_of_total(work.frame(), "region", "amount"))
    assert rows[0] == {"region": "East", "total": 12000.0, "percentage": 57.69}
    top = as_dicts(agg.top_values(work.frame(), "status", 1))
    assert top == [{"value": "active", "count": 4, "percentage": 66.67}]


def test_duplicates_count_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "b")], "a int, b string")
    assert quality.duplicate_summary(df).first().asDict() == {
        "duplicate_count": 1, "total_rows": 4, "duplicate_pct": 25.0
    }
    assert [tuple(r) for r in quality.duplicate_groups(df).collect()] == [(1, None, 2)]


def test_duplicates_of_wide_rows(spark):
    nan, cells = float("nan"), "a string, b string, x double, l array<int>"
    rows = [("a", None, 0.0, [1, None]), (None, "a", 0.0, [1, None]), ("a", None, -0.0, [None, 1]), ("a", None, -0.0, [1, None])]
    rows += [(None, None, nan, None)] * 3 + [("", None, None, []), (None, "", None, [])]
    df = spark.createDataFrame(rows, cells)
    assert quality.duplicate_summary(df).first()[:2] == (3, 9)
    got = sorted((r.a or "", r.occurrence_count) for r in quality.duplicate_groups(df).collect())
    assert got == [("", 3), ("a", 2)]
    assert quality.duplicate_summary(df.limit(0)).first()[:2] == (0, 0)
    assert quality.duplicate_groups(df.limit(0)).collect() == []
    # Texts do not leave the scan.
    plan = quality.duplicate_summary(df, ["a", "b", "x"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__d1" in plan and "SortAggregate" not in plan


def test_duplicate_groups_with_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr("tabloom.operators.quality.lookup", functools.partial(joins.lookup, broadcast_bytes=0))
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('r', id % 2500) END AS v", "repeat('x', 50) AS w")
    want = df.groupBy("v", "w").count().where("count > 1")
    got = quality.duplicate_groups(df)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_first_per_key_needs_an_order(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="order"):
        quality.first_per_key(df, ["k"])


def test_lookup_salted_equals_broadcast(spark):
    df = spark.createDataFrame([(1, "a")] * 300 + [(2, "b"), (None, "c"), (9, "d")], "k int, v string")
    side = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    for how in ("left", "inner"):
        small = joins.lookup(df, side, ["k"], how)
        large = joins.lookup(df, side, ["k"], how, broadcast_bytes=0)
        assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, large.collect()), key=repr)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    got = {(r["column"], r["other"]): r["correlation"] for r in features.correlation(df).collect()}
    assert got["x", "x"] == pytest.approx(1.0) and got["x", "c"] is None and got["c", "c"] is None
    assert {r["c_minmax"] for r in features.scale(df, "c").collect()} == {None}


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (4.0, None), (9.0, "a"), (2.0, "b")], "x double, s string")
    got = [tuple(r) for r in features.impute(df).collect()]
    assert (3.0, "a") in got and (4.0, "a") in got
    empty = spark.createDataFrame([(None, None)], "x double, s string")
    assert [tuple(r) for r in features.impute(empty).collect()] == [(None, "Unknown")]


def test_funnel_without_rows(spark):
    df = spark.createDataFrame([], "id int, status string, amount double")
    row = agg.funnel(df, "id", ["status", "amount"], F.col("status") == "active", F.col("amount") > 5000).first()
    assert tuple(row) == (0, 0, 0, None, None)


def test_roles():
    columns = ["Region", "Price", "created_at", "amount"]
    assert profile.find_role(columns, "amount") == "Price"
    assert profile.find_role(columns, "trend_value") == "amount"
    assert profile.find_role(columns, "date") == "created_at"
    assert profile.find_role(columns, "status") is None
    assert profile.find_role(columns, "status", "Region") == "Region"


@pytest.mark.parametrize("name", list(analyses.ANALYSES))
def test_analyses_run(spark, name):
    rows = [(i, ["active", "inactive"][i % 2], 100.0 * i, "NSEW"[i % 4], f"2024-0{1 + i % 3}-1{i % 10}") for i in range(40)]
    work = Workbench(spark)
    df = spark.createDataFrame(rows, "id int, status string, amount double, region string, timestamp string")
    work.register("data", df.withColumn("_row", F.col("id").cast("long")))
    results = work.run(name)[name]
    assert results
    for result in results.values():
        result.collect()


def test_chaining(work):
    with pytest.warns(UserWarning, match="no analysis"):
        results = work.run("sample_data_demo", "missing", "basic_patterns")
    assert list(results) == ["sample_data_demo", "basic_patterns"]
    # The tier column made by the first analysis is on the table.
    assert "tier" in work.columns


def test_charts(work):
    kind, data = work.auto_chart()
    assert kind == "Bar" and data.columns == ["x", "y"]
    work.sql("SELECT timestamp, id FROM sales")
    kind, data = work.auto_chart()
    assert kind == "Line" and data.count() == 7
    with pytest.raises(ValueError):
        work.chart("Pie")


def test_date_features_drop_bad_dates(spark):
    df = spark.createDataFrame([("2024-01-06",), ("nope",), (None,)], "d string")
    assert [tuple(r) for r in filters.with_date_features(df, "d").collect()] == [("2024-01-06", 2024, 1, "Saturday", True)]


def test_reconcile_picks_tables(spark):
    rows = spark.createDataFrame([("1", "a", 1)], "key string, v string, _row int")
    work = Workbench(spark)
    work.register("target_db", rows)
    with pytest.raises(ValueError, match="two tables"):
        work.reconcile(Plan("key", ("v",)))
    work.register("zzz", rows.withColumn("v", F.lit("other")))
    assert work.reconcile(Plan("key", ("v",)))["summary"].first()["nok"] == 1
    work.register("source_db", rows)
    assert work.reconcile(Plan("key", ("v",)))["summary"].first()["nok"] == 0


def test_unknown_roles_are_reported(work):
    with pytest.raises(ValueError, match="unknown roles"):
        work.run("basic_patterns", colour="red")


def test_analyses_without_their_columns_return_fewer_results(spark, tiny):
    """A table with none of the usual names, straight from Parquet and so without row numbers."""
    work = Workbench(spark)
    work.register("supplier", spark.read.parquet(f"{tiny}/supplier.parquet"))
    for name in analyses.ANALYSES:
        for result in work.run(name)[name].values():
            result.count()


def test_any_aggregate_by_name(work):
    assert work.aggregate("status", "amount", "skewness").count() > 0


def test_repeated_headers_are_cleaned(spark):
    from tabloom.operators.reconcile import clean

    df = spark.createDataFrame([(" a ", "b")], "x string, y string").toDF("h", "h")
    assert [tuple(r) for r in clean(df).collect()] == [("a", "b")] and len(set(clean(df).columns)) == 2
