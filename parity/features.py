"""Feature preparation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import features

from .registry import GAPS_SQL, gaps, query, table


@query(
    "impute",
    f"""WITH g AS (SELECT event_id, kind, TRY_CAST(amount AS DOUBLE) AS amount FROM ({GAPS_SQL}))
        SELECT event_id, COALESCE(amount, (SELECT MEDIAN(amount) FROM g)) AS amount,
               COALESCE(kind, (SELECT kind FROM g WHERE kind IS NOT NULL GROUP BY kind ORDER BY COUNT(*) DESC, kind LIMIT 1))
                   AS kind FROM g""",
)
def impute(spark, sf_dir):
    rows = gaps(spark, sf_dir).selectExpr("event_id", "kind", "try_cast(amount as double) AS amount")
    return features.impute(rows, numeric=["amount"], text=["kind"])


@query(
    "one_hot",
    """SELECT c_custkey, c_name, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING,
              (c_mktsegment = 'FURNITURE')::INT AS c_mktsegment_FURNITURE,
              (c_mktsegment = 'HOUSEHOLD')::INT AS c_mktsegment_HOUSEHOLD,
              (c_mktsegment = 'MACHINERY')::INT AS c_mktsegment_MACHINERY FROM customer""",
)
def one_hot(spark, sf_dir):
    # c_name has too many values and passes through.
    return features.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "one_hot_named",
    "SELECT p_partkey, " + ", ".join(f"(p_brand = '{b}')::INT AS \"p_brand_{b}\"" for b in sorted(_BRANDS)[1:]) + " FROM part",
)
def one_hot_named(spark, sf_dir):
    """A named column is encoded whatever its number of values."""
    return features.one_hot(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand"])


@query(
    "min_max_scale",
    """SELECT o_orderkey, ROUND((o_totalprice - MIN(o_totalprice) OVER ()) /
              (MAX(o_totalprice) OVER () - MIN(o_totalprice) OVER ()), 8) AS o_totalprice_minmax FROM orders""",
)
def min_max(spark, sf_dir):
    rows = features.scale(table(spark, sf_dir, "orders"), "o_totalprice")
    return rows.select("o_orderkey", F.round("o_totalprice_minmax", 8).alias("o_totalprice_minmax"))


@query(
    "z_score",
    """SELECT o_orderkey, ROUND((o_totalprice - (SELECT AVG(o_totalprice) FROM orders)) /
              (SELECT STDDEV_SAMP(o_totalprice) FROM orders), 6) AS o_totalprice_standardized FROM orders""",
)
def z_score(spark, sf_dir):
    rows = features.scale(table(spark, sf_dir, "orders"), "o_totalprice")
    return rows.select("o_orderkey", F.round("o_totalprice_standardized", 6).alias("o_totalprice_standardized"))


_PAIRS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", '{b}' AS other, ROUND(CORR({a}, {b}), 6) AS correlation FROM lineitem"
        for a in _PAIRS
        for b in _PAIRS
    ),
)
def correlation(spark, sf_dir):
    rows = features.correlation(table(spark, sf_dir, "lineitem"), _PAIRS)
    return rows.withColumn("correlation", F.round("correlation", 6))


@query(
    "correlation_matrix",
    """SELECT 'doc_id' AS "column", ROUND(CORR(doc_id, doc_id), 6) AS doc_id, ROUND(CORR(doc_id, n_chars), 6) AS n_chars
       FROM documents
       UNION ALL SELECT 'n_chars', ROUND(CORR(n_chars, doc_id), 6), ROUND(CORR(n_chars, n_chars), 6) FROM documents""",
)
def correlation_matrix(spark, sf_dir):
    rows = features.correlation_matrix(table(spark, sf_dir, "documents"), ["doc_id", "n_chars"])
    return rows.withColumns({c: F.round(c, 6) for c in ("doc_id", "n_chars")})


@query(
    "modes",
    """WITH c AS (SELECT 'l_returnflag' AS "column", l_returnflag AS mode, COUNT(*) AS n FROM lineitem GROUP BY 2
                  UNION ALL SELECT 'l_linestatus', l_linestatus, COUNT(*) FROM lineitem GROUP BY 2)
       SELECT "column", mode FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, mode) = 1""",
)
def modes(spark, sf_dir):
    found = features.modes(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame(list(found.items()), "column string, mode string")
