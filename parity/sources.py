"""Text sources and sinks: data derived from the tables is written as text and loaded back."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import Workbench
from tabloom.sinks import files
from tabloom.sources import tables, text
from tabloom.staging import new_path

from .registry import query, table


def _write_lines(rows, line, order, label):
    """Lines in a total order, so that the file order is known."""
    path = new_path(rows.sparkSession, label)
    rows.orderBy(order).select(F.expr(line).alias("value")).write.text(path)
    return path


_FLAT_LINE = (
    """concat_ws(',', o_orderkey, concat('"', o_orderstatus, ', ""', o_orderpriority, '""', '"'),"""
    """ CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('  ', o_custkey, ' ') END)"""
    """ || CASE WHEN o_orderpriority = '5-LOW' THEN ',extra,cells' WHEN o_orderpriority = '1-URGENT' THEN '' ELSE ',x' END"""
)


@query(
    "flat_text_load",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus || ', "' || o_orderpriority || '"' AS label,
              CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS customer,
              CASE o_orderpriority WHEN '5-LOW' THEN 'extra' WHEN '1-URGENT' THEN NULL ELSE 'x' END AS note,
              ROW_NUMBER() OVER (ORDER BY o_orderkey) AS _row FROM orders""",
)
def flat_text_load(spark, sf_dir):
    path = _write_lines(table(spark, sf_dir, "orders"), _FLAT_LINE, "o_orderkey", "flat")
    layout = text.Layout(header=False, kv=False, col_names=("id", "label", "customer", "note"))
    return text.load_flat(spark, path, layout)


@query(
    "flat_text_header",
    """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
              ROW_NUMBER() OVER (ORDER BY s_suppkey) AS _row FROM supplier""",
)
def flat_text_header(spark, sf_dir):
    path = new_path(spark, "header")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows.orderBy("s_suppkey").write.option("header", True).csv(path)
    return tables.read_table(spark, path, typed=False).df


@query(
    "flat_text_no_names",
    """SELECT CAST(n_nationkey AS VARCHAR) AS col_0, n_name AS col_1, CAST(n_regionkey AS VARCHAR) AS col_2,
              ROW_NUMBER() OVER (ORDER BY n_nationkey) AS _row FROM nation""",
)
def flat_text_no_names(spark, sf_dir):
    path = _write_lines(table(spark, sf_dir, "nation"), "concat_ws(',', n_nationkey, n_name, n_regionkey)", "n_nationkey", "plain")
    return tables.read_table(spark, path, header=False, typed=False).df


_KV_LINE = (
    "concat_ws(',', event_id, concat('type:', event_type),"
    " CASE WHEN value < 50 THEN 'loose' ELSE concat(' value : ', cast(value as string)) END,"
    " concat('user:', user_id), CASE WHEN event_type = 'click' THEN 'user:first:click' END,"
    " date_format(ts, 'yyyy-MM-dd HH.mm.ss'))"
    " || CASE WHEN event_type = 'error' THEN '\\n,, \\n' ELSE '' END"
)


@query(
    "key_value_load",
    """SELECT CAST(event_id AS VARCHAR) AS id, STRFTIME(ts, '%Y-%m-%d %H.%M.%S') AS timestamp, event_type AS type,
              CASE WHEN value >= 50 THEN CAST(value AS VARCHAR) END AS value,
              CASE WHEN event_type = 'click' THEN 'first:click' ELSE CAST(user_id AS VARCHAR) END AS user,
              ROW_NUMBER() OVER (ORDER BY event_id) AS _row FROM events""",
)
def key_value_load(spark, sf_dir):
    path = _write_lines(table(spark, sf_dir, "events"), _KV_LINE, "event_id", "kv")
    return text.load_key_value(spark, path, text.Layout(header=False)).select(
        "id", "timestamp", "type", "value", "user", "_row"
    )


@query(
    "key_value_short_rows",
    """SELECT CASE WHEN role = 'user' THEN CAST(conv_id AS VARCHAR) END AS id,
              CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END AS timestamp,
              CASE WHEN role = 'user' THEN 'user' END AS role,
              ROW_NUMBER() OVER (ORDER BY conv_id, turn, role) AS _row FROM conversations""",
)
def key_value_short_rows(spark, sf_dir):
    line = "CASE WHEN role = 'user' THEN concat_ws(',', conv_id, concat('role:', role), turn) ELSE 'solo' END"
    path = new_path(spark, "kv")
    rows = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn", "role")
    rows.select(F.expr(line).alias("value")).write.text(path)
    return text.load_key_value(spark, path, text.Layout(header=False))


@query(
    "typed_csv_load",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
              ROW_NUMBER() OVER (ORDER BY o_orderkey) AS _row FROM orders""",
)
def typed_csv_load(spark, sf_dir):
    path = new_path(spark, "typed")
    table(spark, sf_dir, "orders").orderBy("o_orderkey").write.option("header", True).csv(path)
    return tables.read_table(spark, path).df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "renamed_csv_load",
    """SELECT p_partkey AS part, p_name AS name, p_brand, ROW_NUMBER() OVER (ORDER BY p_partkey) AS _row FROM part""",
)
def renamed_csv_load(spark, sf_dir):
    path = new_path(spark, "renamed")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    rows.orderBy("p_partkey").write.option("header", True).csv(path)
    return tables.read_table(spark, path, header=True, col_names=["part", "name"]).df


@query(
    "semicolon_and_tab_load",
    """SELECT s_suppkey, s_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def semicolon_and_tab_load(spark, sf_dir):
    folder = new_path(spark, "delimited")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    supplier.write.options(header=True, sep=";").csv(f"{folder}/supplier.csv")
    nation.write.options(header=True, sep="\t").csv(f"{folder}/nation.tsv")
    work = Workbench(spark).load(f"{folder}/supplier.csv:s", f"{folder}/nation.tsv:n", sep="auto", header=True)
    return work.sql("SELECT s_suppkey, s_name, n_nationkey, n_name FROM s JOIN n ON s.s_nationkey = n.n_nationkey")


@query("parquet_load", "SELECT * FROM orders WHERE o_totalprice >= 50000")
def parquet_load(spark, sf_dir):
    work = Workbench(spark).load(f"{sf_dir}/orders.parquet:sales", f"{sf_dir}/customer.parquet")
    work.set_active_table("sales")
    return work.filter("o_totalprice >= 50000")


@query("csv_sink", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_sink(spark, sf_dir):
    path = new_path(spark, "sink")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    files.export(rows, path, "CSV")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("json_sink", "SELECT event_id, ts, event_type, value, props FROM events")
def json_sink(spark, sf_dir):
    path = new_path(spark, "sink")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    files.export(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query("parquet_sink", "SELECT * FROM lineitem")
def parquet_sink(spark, sf_dir):
    path = new_path(spark, "sink")
    work = Workbench(spark)
    work.register("lineitem", table(spark, sf_dir, "lineitem"))
    work.export_parquet(path)
    return spark.read.parquet(path)


@query(
    "export_last_result",
    "SELECT o_orderstatus, COUNT(*) AS count, ROUND(SUM(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1",
)
def export_last_result(spark, sf_dir):
    path = new_path(spark, "sink")
    work = Workbench(spark)
    work.register("orders", table(spark, sf_dir, "orders"))
    work.aggregate("o_orderstatus", "o_totalprice")
    work.export_last(path, "parquet")
    return spark.read.parquet(path)


@query(
    "guessed_separator_load",
    """SELECT o_orderkey, o_custkey, o_orderpriority, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS _row FROM orders""",
)
def guessed_separator_load(spark, sf_dir):
    """The separator of a plain load of many files is guessed."""
    path = new_path(spark, "guessed")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows.repartitionByRange(16, "o_orderkey").sortWithinPartitions("o_orderkey").write.options(header=True, sep=";").csv(path)
    return tables.read_table(spark, path).df


_NOTE = """concat(o_orderpriority, '\n"', o_orderstatus, '", second line', repeat('\n', cast(o_custkey % 3 as int)), 'end')"""


@query(
    "quoted_breaks_load",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
              o_orderpriority || chr(10) || '"' || o_orderstatus || '", second line' || repeat(chr(10), CAST(o_custkey % 3 AS INT)) || 'end' AS note,
              CAST(o_custkey AS VARCHAR) AS o_custkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS _row FROM orders""",
)
def quoted_breaks_load(spark, sf_dir):
    """Line breaks in quotes stay in their cell; the files are split like any others."""
    path = new_path(spark, "breaks")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NOTE).alias("note"), "o_custkey")
    ordered = rows.repartitionByRange(12, "o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.write.options(header=True, escape='"', quote='"').csv(path)
    return tables.read_table(spark, path, header=True, typed=False, multi_line=True).df


@query(
    "key_value_breaks_load",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type || chr(10) || 'more' AS note, CAST(user_id AS VARCHAR) AS user,
              ROW_NUMBER() OVER (ORDER BY event_id) AS _row FROM events""",
)
def key_value_breaks_load(spark, sf_dir):
    """Key:value rows may span lines too, and are known as such without being told."""
    path = new_path(spark, "kv-breaks")
    line = """concat(event_id, ',"note:', event_type, '\nmore",user:', user_id, ',end')"""
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(line).alias("value"))
    lines.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return tables.read_table(spark, path, header=False, kv=True, multi_line=True).df.select("id", "note", "user", "_row")


@query(
    "key_value_detected",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, CAST(user_id AS VARCHAR) AS user, STRFTIME(ts, '%Y-%m-%d') AS timestamp,
              ROW_NUMBER() OVER (ORDER BY event_id) AS _row FROM events""",
)
def key_value_detected(spark, sf_dir):
    """A plain load finds out that rows are key:value."""
    path = new_path(spark, "kv-detected")
    line = "concat_ws(',', event_id, concat('type:', event_type), concat('user:', user_id), date_format(ts, 'yyyy-MM-dd'))"
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(line).alias("value"))
    lines.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return Workbench(spark).load(f"{path}:loaded").frame().select("id", "type", "user", "timestamp", "_row")


_WIDE = 40


@query(
    "key_value_wide",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, "
    + ", ".join(f"CASE WHEN o_orderkey % {i + 2} <> 0 THEN CAST(o_custkey + {i + (_WIDE if i < 3 else 0)} AS VARCHAR) END AS k{i}" for i in range(_WIDE))
    + ", ROW_NUMBER() OVER (ORDER BY o_orderkey) AS _row FROM orders",
)
def key_value_wide(spark, sf_dir):
    """Rows of many entries, some keys repeated: the last entry counts."""
    path = new_path(spark, "kv-wide")
    cells = [f"CASE WHEN o_orderkey % {i + 2} <> 0 THEN concat('k{i}:', o_custkey + {i}) END" for i in range(_WIDE)]
    again = [f"CASE WHEN o_orderkey % {i + 2} <> 0 THEN concat('k{i}:', o_custkey + {i + _WIDE}) END" for i in range(3)]
    line = f"concat_ws(',', o_orderkey, {', '.join(cells + again)}, 'end')"
    # Lines are put together once, in their place: the sample of the keys and the shuffle see the orders, not the wide text.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.expr(line).alias("value")).write.text(path)
    return text.load_key_value(spark, path, text.Layout(header=False)).drop("timestamp")


_BAD_LINE = (
    "concat_ws(',', o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN concat('about ', o_custkey) ELSE cast(o_custkey as string) END,"
    " CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 11 = 0 THEN 'one,two' END)"
)


@query(
    "malformed_rows_load",
    """SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS customer,
              CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority WHEN o_orderkey % 11 = 0 THEN 'one' END AS priority,
              CASE WHEN o_custkey % 7 = 0 THEN 'about ' || o_custkey END AS unread,
              CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0 THEN '["one","two"]' WHEN o_orderkey % 11 = 0 THEN '["two"]' END AS surplus,
              CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0 THEN '1' END AS missing,
              ROW_NUMBER() OVER (ORDER BY o_orderkey) AS _row FROM orders""",
)
def malformed_rows_load(spark, sf_dir):
    """Cells that cannot be read as their type, surplus and missing ones stay with their row."""
    path = new_path(spark, "malformed")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_BAD_LINE).alias("value"))
    lines.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    rows = text.load_rescued(spark, path, "o_orderkey long, customer long, priority string", text.Layout(header=False, sep=","))
    part = lambda key: F.try_element_at(F.col(text.RESCUED), F.lit(key))
    return rows.select("o_orderkey", "customer", "priority", part("customer").alias("unread"), part(text.SURPLUS).alias("surplus"), part(text.MISSING).alias("missing"), "_row")


@query(
    "malformed_counts",
    """SELECT COUNT(*) AS rows, COUNT(*) FILTER (o_custkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 5 = 0) AS malformed,
              COUNT(*) FILTER (o_custkey % 7 = 0) AS unread, COUNT(*) FILTER (o_orderkey % 11 = 0) AS surplus,
              COUNT(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0) AS missing FROM orders""",
)
def malformed_counts(spark, sf_dir):
    """The report of a load, summed over its files."""
    path = new_path(spark, "malformed")
    lines = table(spark, sf_dir, "orders").select(F.expr(_BAD_LINE).alias("value"))
    lines.repartition(5).write.text(path)
    rows = text.load_rescued(spark, path, "o_orderkey long, customer long, priority string", text.Layout(header=False, sep=","))
    counted = text.malformed_counts(rows)
    return counted.agg(*[F.sum(c).alias(c) for c in counted.columns if c != "_file"])


@query(
    "text_fallback_load",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_custkey % 7 = 0 THEN 'about ' ELSE '' END || o_custkey AS customer,
              ROW_NUMBER() OVER (ORDER BY o_orderkey) AS _row FROM orders""",
)
def text_fallback_load(spark, sf_dir):
    """A load whose rows do not fit the types keeps all cells as text."""
    path = new_path(spark, "fallback")
    line = "concat(o_orderkey, ',', CASE WHEN o_custkey % 7 = 0 THEN 'about ' ELSE '' END, o_custkey)"
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(line).alias("value"))
    lines.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return text.load_or_text(spark, path, "key long, customer long", text.Layout(header=False, sep=","))


@query("parquet_folder_load", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def parquet_folder_load(spark, sf_dir):
    """A Parquet folder of many files is known by its files."""
    path = new_path(spark, "plain-folder")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    rows.repartition(9, "o_orderkey").write.parquet(path)
    return tables.read_table(spark, path).df
