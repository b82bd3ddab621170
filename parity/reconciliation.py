"""Keyed comparison of two sides derived from the order lines.

Left: lines with status O; right: lines with status F.  Both sides have repeated
keys and keys the other side lacks, and differ in flag, year and code list.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import Workbench
from tabloom.functions import codes
from tabloom.operators import reconcile as rc
from tabloom.operators.ordered import asc
from tabloom.sinks import files
from tabloom.staging import new_path

from .registry import ORACLES, query, table

PLAN = rc.Plan(
    key="order",
    columns=("flag", "year", "codes"),
    list_columns=("codes",),
    aliases={"flag": ["R,A"]},
    various="(Various VDNs)",
)

# Four codes per line; the first two share a prefix.
_CODES = (
    "'Q0' || LPAD(CAST(CAST(l_quantity AS INT) AS {text}), 2, '0')",
    "'Q0' || LPAD(CAST(l_linenumber AS {text}), 2, '0')",
    "'D0' || LPAD(CAST(CAST(ROUND(l_discount * 100) AS INT) AS {text}), 2, '0')",
    "l_returnflag || 'X' || LPAD(CAST(CAST(ROUND(l_tax * 100) AS INT) AS {text}), 2, '0')",
)


def _side_sql(status: str, text: str) -> str:
    parts = [c.format(text=text) for c in _CODES]
    if status == "O":
        cell = "'[\"' || " + " || '\", \"' || ".join(parts) + " || '\"]'"
    else:
        cell = " || ".join(parts)
    # The first quantity band has no list; one discount has no year.
    return f"""SELECT CAST(l_orderkey AS {text}) AS "order", l_returnflag AS flag,
        CASE WHEN ROUND(l_discount * 100) = 3 THEN 'N/A' ELSE CAST(YEAR(l_shipdate) AS {text}) END AS year,
        CASE WHEN l_quantity <= 5 THEN '' ELSE {cell} END AS codes,
        LPAD(CAST(l_linenumber AS {text}), 3, '0') || LPAD(CAST(l_partkey AS {text}), 12, '0')
            || LPAD(CAST(l_suppkey AS {text}), 12, '0')
            || LPAD(CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS {text}), 14, '0') AS pos
        FROM lineitem WHERE l_linestatus = '{status}'"""


def side(spark, sf_dir, status):
    sql = _side_sql(status, "STRING").replace('"order"', "`order`").replace("FROM lineitem", "FROM {lines}")
    return spark.sql(sql, lines=table(spark, sf_dir, "lineitem"))


def prepared(spark, sf_dir):
    return rc.prepare(side(spark, sf_dir, "O"), PLAN), rc.prepare(side(spark, sf_dir, "F"), PLAN)


def compared(spark, sf_dir, keep_lists=False):
    left, right = prepared(spark, sf_dir)
    order = [asc("pos")]
    return rc.compare(left, right, PLAN, left_order=order, right_order=order, keep_lists=keep_lists)


def _prep_sql(status: str) -> str:
    if status == "O":
        listed = "REGEXP_EXTRACT_ALL(codes, '[A-Z0-9]{4}')"
    else:
        listed = "REGEXP_EXTRACT_ALL(codes, '.{1,4}')"
    return f"""SELECT "order", flag, CASE WHEN flag = 'A' THEN 'R' ELSE flag END AS norm,
        CASE WHEN flag = 'A' THEN 'R(A)' ELSE flag END AS shown, NULLIF(year, 'N/A') AS year,
        CASE WHEN codes = '' THEN [] ELSE LIST_SORT(LIST_DISTINCT({listed})) END AS codes, pos
        FROM ({_side_sql(status, 'VARCHAR')})"""


_LEFT, _RIGHT = _prep_sql("O"), _prep_sql("F")
_FIRST = 'QUALIFY ROW_NUMBER() OVER (PARTITION BY "order" ORDER BY pos) = 1'


def _diff(own: str, other: str) -> str:
    return (
        f"CASE WHEN codes_match = 'MATCH' THEN '' WHEN {own} IS NULL OR LEN({own}) = 0 THEN 'NO DATA' ELSE "
        f"ARRAY_TO_STRING(LIST_SORT([x FOR x IN {own} IF NOT LIST_CONTAINS(COALESCE({other}, []), x)]), ', ') END"
    )


_COMPARED = f"""
    l AS (SELECT * FROM ({_LEFT}) {_FIRST}), r AS (SELECT * FROM ({_RIGHT}) {_FIRST}),
    j AS (SELECT COALESCE(l."order", r."order") AS "order",
        CASE WHEN l."order" IS NULL THEN 0 ELSE 1 END AS in_left,
        CASE WHEN r."order" IS NULL THEN 0 ELSE 1 END AS in_right,
        CASE WHEN l."order" IS NULL THEN 'N/A' ELSE COALESCE(l.shown, 'NO DATA') END AS left_flag,
        CASE WHEN r."order" IS NULL THEN 'N/A' ELSE COALESCE(r.shown, 'NO DATA') END AS right_flag,
        CASE WHEN l."order" IS NULL OR r."order" IS NULL THEN 'MISMATCH'
             WHEN l.norm IS NOT DISTINCT FROM r.norm THEN 'MATCH' ELSE 'MISMATCH' END AS flag_match,
        CASE WHEN l."order" IS NULL THEN 'N/A' ELSE COALESCE(l.year, 'NO DATA') END AS left_year,
        CASE WHEN r."order" IS NULL THEN 'N/A' ELSE COALESCE(r.year, 'NO DATA') END AS right_year,
        CASE WHEN l."order" IS NULL OR r."order" IS NULL THEN 'MISMATCH'
             WHEN l.year IS NOT DISTINCT FROM r.year THEN 'MATCH' ELSE 'MISMATCH' END AS year_match,
        CASE WHEN l."order" IS NULL OR r."order" IS NULL THEN 'MISMATCH'
             WHEN l.codes IS NOT DISTINCT FROM r.codes THEN 'MATCH' ELSE 'MISMATCH' END AS codes_match,
        l.codes AS lc, r.codes AS rc
        FROM l FULL OUTER JOIN r ON l."order" = r."order"),
    c AS (SELECT * EXCLUDE (lc, rc), lc, rc, {_diff('lc', 'rc')} AS only_left_codes,
        {_diff('rc', 'lc')} AS only_right_codes,
        CASE WHEN flag_match = 'MISMATCH' OR year_match = 'MISMATCH' OR codes_match = 'MISMATCH' THEN 'NOK' ELSE 'OK' END
            AS result FROM j)"""
_RESULTS = f"WITH {_COMPARED} SELECT * EXCLUDE (lc, rc) FROM c"


@query("recon_compare", _RESULTS)
def recon_compare(spark, sf_dir):
    return compared(spark, sf_dir)


@query("recon_sorted", _RESULTS)
def recon_sorted(spark, sf_dir):
    return rc.sort_by_key(compared(spark, sf_dir), PLAN, "desc")


@query("recon_only_left", _RESULTS + " WHERE in_right = 0")
def recon_only_left(spark, sf_dir):
    return rc.only_left(compared(spark, sf_dir))


@query("recon_only_right", _RESULTS + " WHERE in_left = 0")
def recon_only_right(spark, sf_dir):
    return rc.only_right(compared(spark, sf_dir))


@query("recon_mismatches", _RESULTS + " WHERE in_left = 1 AND in_right = 1 AND year_match = 'MISMATCH'")
def recon_mismatches(spark, sf_dir):
    return rc.mismatches(compared(spark, sf_dir), "year")


@query("recon_not_ok", _RESULTS + " WHERE result = 'NOK'")
def recon_not_ok(spark, sf_dir):
    return rc.not_ok(compared(spark, sf_dir))


@query("recon_sample", _RESULTS + " WHERE result = 'NOK' ORDER BY \"order\" LIMIT 10")
def recon_sample(spark, sf_dir):
    return rc.sample(rc.not_ok(compared(spark, sf_dir)), PLAN, 10)


@query(
    "recon_summary",
    f"""WITH {_COMPARED} SELECT COUNT(*) AS total_keys, COUNT(*) FILTER (in_left = 1) AS left_keys,
        COUNT(*) FILTER (in_right = 1) AS right_keys, COUNT(*) FILTER (in_right = 0) AS only_left,
        COUNT(*) FILTER (in_left = 0) AS only_right, """
    + ", ".join(
        f"COUNT(*) FILTER (in_left = 1 AND in_right = 1 AND {c}_match = 'MISMATCH') AS {c}_mismatches, "
        f"COUNT(*) FILTER ({c}_match = 'MATCH') AS {c}_matches"
        for c in PLAN.columns
    )
    + ", COUNT(*) FILTER (result = 'NOK') AS nok FROM c",
)
def recon_summary(spark, sf_dir):
    return rc.summary(compared(spark, sf_dir), PLAN)


_BOTH = "in_left = 1 AND in_right = 1"


@query(
    "recon_matrix",
    f"""WITH {_COMPARED}, m AS (SELECT left_flag, right_flag FROM c WHERE {_BOTH} AND flag_match = 'MISMATCH')
        SELECT COALESCE(left_flag, 'TOTAL') AS left_flag, COUNT(*) FILTER (right_flag = 'N') AS "N",
               COUNT(*) FILTER (right_flag = 'R') AS "R", COUNT(*) FILTER (right_flag = 'R(A)') AS "R(A)",
               COUNT(*) AS "TOTAL" FROM m GROUP BY ROLLUP (left_flag)""",
)
def recon_matrix(spark, sf_dir):
    return rc.mismatch_matrix(compared(spark, sf_dir), "flag")


@query(
    "recon_tally",
    f"""WITH {_COMPARED} SELECT left_year, right_year, COUNT(*) AS count FROM c
        WHERE {_BOTH} AND year_match = 'MISMATCH' GROUP BY ALL""",
)
def recon_tally(spark, sf_dir):
    return rc.mismatch_tally(compared(spark, sf_dir), "year")


_TALLY = f"""WITH {_COMPARED},
    m AS (SELECT "order" AS k, lc, rc FROM c WHERE {_BOTH} AND codes_match = 'MISMATCH'),
    lo AS (SELECT k, v, LEFT(v, 2) AS p FROM (SELECT k, UNNEST([x FOR x IN lc IF NOT LIST_CONTAINS(rc, x)]) AS v FROM m)),
    ro AS (SELECT k, v, LEFT(v, 2) AS p FROM (SELECT k, UNNEST([x FOR x IN rc IF NOT LIST_CONTAINS(lc, x)]) AS v FROM m)),
    ln AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, p ORDER BY v) AS i FROM lo),
    rn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, p ORDER BY v) AS i FROM ro),
    a AS (SELECT COALESCE(ln.k, rn.k) AS k, COALESCE(ln.v, 'No Match') AS "left", COALESCE(rn.v, 'No Match') AS "right"
          FROM ln FULL OUTER JOIN rn ON ln.k = rn.k AND ln.p = rn.p AND ln.i = rn.i)
    SELECT * FROM (
        SELECT 'No Match' AS "left", '(Various VDNs)' AS "right", COUNT(DISTINCT k) AS count FROM a WHERE "left" = 'No Match'
        UNION ALL
        SELECT '(Various VDNs)', 'No Match', COUNT(DISTINCT k) FROM a WHERE "right" = 'No Match'
        UNION ALL
        SELECT "left", "right", COUNT(DISTINCT k) FROM a WHERE "left" <> 'No Match' AND "right" <> 'No Match' GROUP BY 1, 2)
    WHERE count > 0"""


@query("recon_code_tally", _TALLY)
def recon_code_tally(spark, sf_dir):
    return rc.code_tally(compared(spark, sf_dir, keep_lists=True), "codes", PLAN.various)


@query("recon_duplicate_keys", f'SELECT "order", COUNT(*) AS rows FROM ({_LEFT}) GROUP BY 1 HAVING COUNT(*) > 1')
def recon_duplicate_keys(spark, sf_dir):
    return rc.audit_duplicates(prepared(spark, sf_dir)[0], PLAN)


@query(
    "recon_extra_rows",
    f"""WITH g AS (SELECT "order", COUNT(*) AS n FROM ({_RIGHT}) GROUP BY 1)
        SELECT COUNT(*) FILTER (n > 1) AS duplicate_keys, CAST(SUM(n) - COUNT(*) AS BIGINT) AS extra_rows FROM g""",
)
def recon_extra_rows(spark, sf_dir):
    return rc.audit_extra_rows(prepared(spark, sf_dir)[1], PLAN)


@query(
    "recon_prefix_conflicts",
    f"""WITH p AS (SELECT pos, "order", v, UPPER(LEFT(v, 2)) AS p FROM (SELECT pos, "order", UNNEST(codes) AS v FROM ({_LEFT}))),
             g AS (SELECT pos, "order", p, STRING_AGG(v, '/' ORDER BY v) AS vs, COUNT(*) AS n FROM p GROUP BY ALL)
        SELECT "order", STRING_AGG(p || '(' || vs || ')', ', ' ORDER BY p) AS conflicts FROM g WHERE n > 1
        GROUP BY pos, "order" """,
)
def recon_prefix_conflicts(spark, sf_dir):
    return rc.audit_prefix_conflicts(prepared(spark, sf_dir)[0], PLAN, "codes")


@query(
    "recon_empty_columns",
    f"""WITH p AS ({_LEFT}) SELECT * FROM (
        SELECT 'flag' AS "column", COUNT(DISTINCT "order") FILTER (flag IS NULL) AS keys FROM p
        UNION ALL SELECT 'year', COUNT(DISTINCT "order") FILTER (year IS NULL) FROM p
        UNION ALL SELECT 'codes', COUNT(DISTINCT "order") FILTER (LEN(codes) = 0) FROM p) WHERE keys > 0""",
)
def recon_empty_columns(spark, sf_dir):
    return rc.audit_empty_columns(prepared(spark, sf_dir)[0], PLAN)


@query(
    "recon_empty_keys",
    f"""WITH g AS (SELECT "order", BOOL_OR(year IS NULL) AS y, BOOL_OR(LEN(codes) = 0) AS c FROM ({_RIGHT}) GROUP BY 1)
        SELECT "order", CASE WHEN y AND c THEN 'year, codes' WHEN y THEN 'year' ELSE 'codes' END AS missing
        FROM g WHERE y OR c""",
)
def recon_empty_keys(spark, sf_dir):
    return rc.audit_empty_keys(prepared(spark, sf_dir)[1], PLAN)


@query(
    "recon_skip_no_data",
    f"""SELECT COUNT(*) FILTER (year IS NULL OR LEN(codes) = 0) AS skipped, COUNT(*) AS rows FROM ({_LEFT})""",
)
def recon_skip_no_data(spark, sf_dir):
    return rc.skipped_no_data(prepared(spark, sf_dir)[0], PLAN)


@query(
    "recon_skip_values",
    f"""SELECT "order", shown, year, ARRAY_TO_STRING(codes, ' ') AS codes FROM ({_LEFT})
        WHERE flag <> 'N' AND (year IS NULL OR year NOT IN ('1997', '1998'))""",
)
def recon_skip_values(spark, sf_dir):
    plan = rc.Plan(PLAN.key, PLAN.columns, PLAN.list_columns, PLAN.aliases, {"FLAG": ["n"], "Year": ["1997 ", "1998"]})
    rows = rc.prepare(side(spark, sf_dir, "O"), plan)
    return rows.select("order", F.col("flag_DISPLAY").alias("shown"), "year", F.array_join("codes", " ").alias("codes"))


@query(
    "recon_renamed",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, UPPER(c_mktsegment) AS segment, CAST(c_nationkey AS VARCHAR) AS nation
       FROM customer""",
)
def recon_renamed(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.expr("concat('  \"', c_custkey, '\" ')").alias("c_custkey"), "c_mktsegment", "c_nationkey"
    )
    shared = {"c_custkey": "key", "c_mktsegment": "zone"}
    renamed = rc.rename(rows, shared, {"c_mktsegment": "segment", "c_nationkey": "nation"})
    return rc.clean(renamed)


@query(
    "code_lists",
    f"""SELECT "order", ARRAY_TO_STRING(codes, '|') AS codes, CAST(LEN(codes) AS INT) AS n FROM ({_RIGHT})""",
)
def code_lists(spark, sf_dir):
    rows = side(spark, sf_dir, "F").withColumn("codes", codes.parse_codes(F.col("codes")))
    return rows.select("order", F.array_join("codes", "|").alias("codes"), F.size("codes").alias("n"))


@query(
    "code_lists_with_repeats",
    f"""SELECT "order", CASE WHEN codes = '' THEN 'NO DATA'
               ELSE ARRAY_TO_STRING(LIST_SORT(REGEXP_EXTRACT_ALL(codes, '[A-Z0-9]{{4}}')), '|') END AS codes
        FROM ({_side_sql('O', 'VARCHAR')})""",
)
def code_lists_with_repeats(spark, sf_dir):
    parsed = codes.parse_codes(F.col("codes"), distinct=False, empty_marker="NO DATA")
    return side(spark, sf_dir, "O").select("order", F.array_join(parsed, "|").alias("codes"))


@query(
    "code_lists_by_prefix",
    f"""SELECT p AS prefix, COUNT(*) AS codes, COUNT(DISTINCT v) AS different
        FROM (SELECT v, LEFT(v, 2) AS p FROM (SELECT UNNEST(codes) AS v FROM ({_RIGHT}))) GROUP BY 1""",
)
def code_lists_by_prefix(spark, sf_dir):
    rows = prepared(spark, sf_dir)[1].select(F.explode_outer("codes").alias("code")).where("code is not null")
    return rows.groupBy(F.substring("code", 1, 2).alias("prefix")).agg(
        F.count("*").alias("codes"), F.count_distinct("code").alias("different")
    )


@query(
    "recon_loaded_tables",
    """WITH l AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), r AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
       SELECT COUNT(*) AS total_keys, COUNT(l.k) AS left_keys, COUNT(r.k) AS right_keys,
              COUNT(*) FILTER (r.k IS NULL) AS only_left, COUNT(*) FILTER (l.k IS NULL) AS only_right,
              COUNT(*) FILTER (l.n <> r.n) AS nation_mismatches, COUNT(*) FILTER (l.n = r.n) AS nation_matches,
              COUNT(*) FILTER (l.n IS DISTINCT FROM r.n) AS nok
       FROM l FULL OUTER JOIN r ON l.k = r.k""",
)
def recon_loaded_tables(spark, sf_dir):
    work = Workbench(spark)
    work.register("customer", rc.rename(table(spark, sf_dir, "customer"), {"c_custkey": "key", "c_nationkey": "nation"}))
    work.register("supplier", rc.rename(table(spark, sf_dir, "supplier"), {"s_suppkey": "key", "s_nationkey": "nation"}))
    order = [asc("nation")]
    return work.reconcile(rc.Plan("key", ("nation", "phone")), left_order=order, right_order=order)["summary"]


@query(
    "recon_written",
    f"WITH {_COMPARED} SELECT \"order\", in_left, in_right, flag_match, year_match, codes_match, result FROM c WHERE result = 'NOK'",
)
def recon_written(spark, sf_dir):
    order = [asc("pos")]
    results = rc.reconcile(
        side(spark, sf_dir, "O"), side(spark, sf_dir, "F"), PLAN, left_order=order, right_order=order
    )
    paths = files.write_reconciliation(results, new_path(spark, "recon"))
    kept = "order", "in_left", "in_right", "flag_match", "year_match", "codes_match", "result"
    written = spark.read.schema(results["not_ok"].schema).option("header", True).csv(paths["mismatch-only"])
    return written.select(*kept)


@query(
    "recon_supplier_customer",
    """WITH s AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1),
            c AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 1)
       SELECT CAST(COALESCE(s.k, c.k) AS VARCHAR) AS nation,
              CASE WHEN s.k IS NULL THEN 'N/A' ELSE CAST(s.n AS VARCHAR) END AS left_n,
              CASE WHEN c.k IS NULL THEN 'N/A' ELSE CAST(c.n AS VARCHAR) END AS right_n,
              CASE WHEN s.n = c.n THEN 'OK' ELSE 'NOK' END AS result
       FROM s FULL OUTER JOIN c ON s.k = c.k""",
)
def recon_supplier_customer(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    right = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    plan = rc.Plan("nation", ("n",))
    order = [asc("n")]
    rows = rc.compare(rc.prepare(left, plan), rc.prepare(right, plan), plan, left_order=order, right_order=order)
    return rows.select("nation", "left_n", "right_n", "result")


#: Each result of the assembled comparison, with the query that states the same rows.
ASSEMBLED = {
    "results": "recon_compare",
    "sorted_results": "recon_sorted",
    "only_left": "recon_only_left",
    "only_right": "recon_only_right",
    "not_ok": "recon_not_ok",
    "sorted_not_ok": "recon_not_ok",
    "summary": "recon_summary",
    "mismatches_year": "recon_mismatches",
    "tally_year": "recon_tally",
    "codes_codes": "recon_code_tally",
    "left_duplicates": "recon_duplicate_keys",
    "right_extra_rows": "recon_extra_rows",
    "left_conflicts_codes": "recon_prefix_conflicts",
    "left_empty_columns": "recon_empty_columns",
    "right_empty": "recon_empty_keys",
    "left_skipped": "recon_skip_no_data",
}


def assembled(spark, sf_dir, name: str):
    order = [asc("pos")]
    return rc.reconcile(side(spark, sf_dir, "O"), side(spark, sf_dir, "F"), PLAN, left_order=order, right_order=order)[name]


for _name, _same in ASSEMBLED.items():
    query(f"assembled_{_name}", ORACLES[_same])(lambda spark, sf_dir, name=_name: assembled(spark, sf_dir, name))


@query(
    "assembled_matrix_flag",
    f"""WITH {_COMPARED}, m AS (SELECT left_flag, right_flag FROM c WHERE {_BOTH} AND flag_match = 'MISMATCH')
        SELECT COALESCE(left_flag, 'TOTAL') AS "row", COALESCE(right_flag, 'TOTAL') AS "column", COUNT(*) AS count
        FROM m GROUP BY CUBE (left_flag, right_flag)""",
)
def assembled_matrix_flag(spark, sf_dir):
    return assembled(spark, sf_dir, "matrix_flag")


@query(
    "code_list_json",
    f"""SELECT "order", pos, CAST(TO_JSON(codes) AS VARCHAR) AS codes FROM ({_LEFT})""",
)
def code_list_json(spark, sf_dir):
    return prepared(spark, sf_dir)[0].select("order", "pos", codes.to_json_list(F.col("codes")).alias("codes"))
