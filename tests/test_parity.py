"""Every query runs on the smallest data and matches its oracle."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
import parity  # noqa: E402
from tools.check_parity import difference, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for name in sorted(f[:-8] for f in os.listdir(tiny) if f.endswith(".parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_queries_are_registered():
    assert set(parity.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(parity.QUERIES))
def test_query(spark, tiny, oracle, name):
    got = rows_of(parity.QUERIES[name](spark, tiny).toArrow())
    sql = parity.ORACLES.get(name)
    if sql is None:
        assert got[2]
        return
    assert difference(got, rows_of(oracle.sql(sql).to_arrow_table())) is None


def test_summary_holds_quartiles_and_distinct_counts(spark, tiny):
    found = parity.QUERIES["summarize"](spark, tiny)
    assert {"q25", "q50", "q75", "distinct_values", "quartiles_within", "distinct_within"} <= set(found.columns)
    assert all(r["quartiles_within"] and r["distinct_within"] and r["distinct_values"] > 0 for r in found.collect())
