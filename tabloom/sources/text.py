"""Delimited text: flat rows, key:value rows and typed CSV."""
from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import FILE, ROW, col, strip
from . import detect
from .lineage import number_rows, tag_splits
from .records import quoted_records


@dataclass(frozen=True)
class Layout:
    """How a text file is laid out; None means: detect (``sep="auto"``: by the first line alone)."""

    header: bool | None = None
    kv: bool | None = None
    col_names: tuple[str, ...] | None = None
    sep: str | None = None


def split_cells(line: Column, sep: str = ",") -> Column:
    """Cells of one line with CSV quoting, as ``array<string>``.

    Lines without a quote take the plain split.  Quoted fields that span lines
    are not supported here; ``load_flat`` and ``load_csv`` read them with ``multi_line``.
    """
    s = re.escape(sep)
    # Every match starts at a separator, so one is put in front of the line.
    field = rf'(?s){s}("[^"]*+(?:""[^"]*+)*+(?:"[^{s}]*|$)|[^{s}]*)'
    matches = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(field), F.lit(1))

    def unquote(cell: Column) -> Column:
        body = F.regexp_extract(cell, r'(?s)^"((?:[^"]|"")*+)"?(.*)$', 1)
        rest = F.regexp_extract(cell, r'(?s)^"((?:[^"]|"")*+)"?(.*)$', 2)
        return F.when(cell.startswith('"'), F.concat(F.replace(body, F.lit('""'), F.lit('"')), rest)).otherwise(cell)

    return F.when(line.contains('"'), F.transform(matches, unquote)).otherwise(F.split(line, s, -1))


def not_blank(line: Column, cells: Column, sep: str = ",") -> Column:
    """True if any cell holds more than whitespace (a cheap test settles most lines)."""
    return line.rlike(rf'[^\s"{re.escape(sep)}]') | F.exists(cells, lambda cell: strip(cell) != "")


def parse_flat(lines: DataFrame, names: Sequence[str], line: str = "value", sep: str = ",") -> DataFrame:
    """Project lines to text columns: cells trimmed, short rows padded, long rows cut, '' as NULL."""
    kept = [c for c in lines.columns if c != line]
    at = {name: i for i, name in enumerate(names)}
    cells = lines.withColumn("__cells", split_cells(col(line), sep))
    cells = cells.where(not_blank(col(line), col("__cells"), sep))
    values = [F.nullif(strip(F.get(col("__cells"), F.lit(i))), F.lit("")).alias(n) for n, i in at.items()]
    return cells.select(*values, *[col(c) for c in kept])


def _kv_entries(cells: Column) -> Column:
    """Entries of a key:value row, from trimmed cells: id, timestamp, then the ``key:value`` cells."""
    width = F.size(cells)

    def entry(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    middle = F.filter(F.slice(cells, F.lit(2), F.greatest(width - 2, F.lit(0))), lambda c: c.contains(":"))
    pairs = F.transform(
        middle,
        lambda c: entry(strip(F.substring_index(c, ":", 1)), strip(F.substr(c, F.instr(c, ":") + 1))),
    )
    ends = F.array(entry(F.lit("id"), F.get(cells, F.lit(0))), entry(F.lit("timestamp"), F.get(cells, width - 1)))
    return F.when(width >= 2, F.concat(ends, pairs))


def kv_entries(lines: DataFrame, line: str = "value", sep: str = ",") -> DataFrame:
    """Lines with their entries; rows of under two cells have none (NULL) but are kept."""
    kept = [c for c in lines.columns if c != line]
    cells = lines.withColumn("__cells", split_cells(col(line), sep))
    cells = cells.where(not_blank(col(line), col("__cells"), sep))
    # Separate projections: the trimmed cells are used several times per row.
    trimmed = cells.select(F.transform("__cells", strip).alias("__cells"), *[col(c) for c in kept])
    return trimmed.select(_kv_entries(col("__cells")).alias("entries"), *[col(c) for c in kept])


def _plain(line: Column, sep: str) -> Column:
    """True for lines of printable ASCII without blanks, quotes and backslashes: nothing to trim, unquote or escape."""
    if len(sep) != 1 or sep in '":\\':
        return F.lit(False)
    # One anchored run: looking for a character outside the class takes ten times as long.
    return line.rlike(rf"^[!#-\[\]-~{re.escape(sep)}]*\z") & (F.length(line) < PLAIN_CHARS)


def _plain_keys(line: Column, sep: str) -> Column:
    """Keys of a plain line, in the order of ``kv_entries``; NULL for under two cells."""
    s = re.escape(sep)
    middle = F.regexp_extract_all(line, F.lit(rf"{s}([^{s}:]*):[^{s}]*(?={s})"), F.lit(1))
    return F.when(line.contains(sep), F.concat(F.array(F.lit("id"), F.lit("timestamp")), middle))


def _plain_object(line: Column, sep: str) -> Column:
    """The entries of a plain line as the text of a JSON object, blank values as null; NULL for under two cells."""
    s = re.escape(sep)
    first, last = F.substring_index(line, sep, 1), F.substring_index(line, sep, -1)
    ends = F.length(first) + F.length(last) + 1
    # Where every cell between the ends has one colon, marks are replaced as they are; else cell by cell, without those that have none.
    regular = line.rlike(rf"^[^{s}]*(?:{s}[^{s}:]*:[^{s}:]*)*{s}[^{s}]*\z")
    marked = F.replace(F.replace(F.substr(line, F.length(first) + 1, F.length(line) - ends), F.lit(sep), F.lit('","')), F.lit(":"), F.lit('":"'))
    pairs_only = F.regexp_replace(line, rf"{s}[^{s}:]*(?={s})", "")
    quoted = F.regexp_replace(pairs_only, rf"{s}([^{s}:]*):([^{s}]*)(?={s})", '","$1":"$2')
    middle = F.when(regular, marked).otherwise(F.substr(quoted, F.length(first) + 1, F.length(quoted) - ends))
    whole = F.concat(F.lit('{"id":"'), first, F.lit('","timestamp":"'), last, middle, F.lit('"}'))
    return F.when(line.contains(sep), F.replace(whole, F.lit(':""'), F.lit(":null")))


def kv_rows(lines: DataFrame, line: str = "value", sep: str = ",") -> DataFrame:
    """Lines for ``discover_keys`` and ``project_keys``: a plain line stays text (``__plain``), others have their entries."""
    kept = [col(c) for c in lines.columns if c != line]
    filled = lines.where(not_blank(col(line), split_cells(col(line), sep), sep))
    marked = filled.select(F.when(_plain(col(line), sep), col(line)).alias("__plain"), col(line), *kept)
    # Separate projections, as in ``kv_entries``; every step is NULL for a plain line.
    cells = marked.select(F.when(col("__plain").isNull(), split_cells(col(line), sep)).alias("__cells"), "__plain", *kept)
    trimmed = cells.select(F.transform("__cells", strip).alias("__cells"), "__plain", *kept)
    return trimmed.select(_kv_entries(col("__cells")).alias("entries"), "__plain", *kept)


def discover_keys(entries: DataFrame, row: str = ROW, max_keys: int | None = None, sep: str = ",") -> list[str]:
    """Keys in first-seen order, by the rows' numbers.  Only the distinct keys reach the driver; a caller may bound them.

    Least numbers and places are plain cells, so they are combined by hashing on the map side; a struct of both would sort every entry.
    """
    names = F.col("entries.key")
    if "__plain" in entries.columns:
        names = F.when(col("__plain").isNotNull(), _plain_keys(col("__plain"), sep)).otherwise(names)
    # A key counts once in a row, so no two of its places have one number.  The outer form: the size filter of a plain
    # explode would parse every line twice.
    seen = (
        entries.select(col(row).alias("__row"), F.posexplode_outer(F.array_distinct(names)).alias("pos", "key"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("__row").alias("first"), F.min_by("pos", "__row").alias("place"))
        .orderBy("first", "place")
    )
    seen = (seen if max_keys is None else seen.limit(max_keys + 1)).collect()
    if max_keys is not None and len(seen) > max_keys:
        raise ValueError(f"more than {max_keys} distinct keys; query kv_entries() in long form instead")
    return [r["key"] for r in seen if r["key"] not in (ROW, "_raw", "_error", "_unparsed")]


#: Longer lines are never taken as plain: a JSON reader bounds the length of names.
PLAIN_CHARS = 50_000
#: From so many columns on, a row's entries are read into them in one go instead of being looked up one by one.
LOOKED_UP = 16


def last_wins(entries: str) -> Column:
    """A map of the entries in which the last of equal keys counts.

    Rows without a repeated key, which one pass over the keys shows, take their entries as they are.  In others sorting by
    key and place puts equal keys side by side, and an entry counts if the next one has another key.
    """
    names = F.transform(entries, lambda e: e["key"])
    in_order = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))))
    behind = F.concat(F.slice(F.transform(in_order, lambda e: e["key"]), 2, F.size(in_order)), F.array(F.lit(None).cast("string")))
    last = F.filter(F.arrays_zip(in_order.alias("e"), behind.alias("next")), lambda p: ~p["e"]["key"].eqNullSafe(p["next"]))
    repaired = F.transform(last, lambda p: F.struct(p["e"]["key"].alias("key"), p["e"]["value"].alias("value")))
    return F.map_from_entries(F.when(F.size(F.array_distinct(names)) == F.size(names), F.col(entries)).otherwise(repaired))


def project_keys(entries: DataFrame, keys: Sequence[str], sep: str = ",") -> DataFrame:
    """One column per key; the last entry of a key wins; blank values are NULL.

    A plain line becomes a JSON object by patterns and is read as one, which costs in proportion to its length.  Other rows'
    entries become one map first.  Few keys are looked up in it; for many, where every lookup would go through the whole map,
    it is read as an object too.
    """
    kept = [col(c) for c in entries.columns if c not in ("entries", "__plain")]
    shape = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    # No key may be taken for the reader's own column.
    options = {"columnNameOfCorruptRecord": "_" * (1 + max(map(len, keys), default=0))}
    plain = _plain_object(col("__plain"), sep) if "__plain" in entries.columns else F.lit(None).cast("string")
    mapped = entries.select(last_wins("entries").alias("__map"), plain.alias("__text"), *kept)
    if len(keys) <= LOOKED_UP:
        # Fields by place: keys may differ in case alone.
        places = T.StructType([T.StructField(f"k{i}", T.StringType()) for i, _ in enumerate(keys)])
        read = mapped.select("__map", F.from_json("__text", shape, options).cast(places).alias("__object"), *kept)
        found = lambda k: F.nullif(F.try_element_at(col("__map"), F.lit(k)), F.lit(""))
        return read.select(*[F.coalesce(F.col(f"__object.k{i}"), found(k)).alias(k) for i, k in enumerate(keys)], *kept)
    # Blank values are left out of the object, so that their cells are NULL.
    filled = F.to_json(F.map_filter("__map", lambda k, v: v != ""))
    return mapped.select(F.from_json(F.coalesce("__text", filled), shape, options).alias("__object"), *kept).select("__object.*", *kept)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths)


def sample_lines(spark: SparkSession, path: str | Sequence[str], count: int = detect.SAMPLE_LINES) -> list[str]:
    """The first non-blank lines of the first file (a constant number)."""
    files = sorted(_lines(spark, path).inputFiles())
    if not files:
        raise ValueError(f"no data found in {path}")
    head = spark.read.text(files[0]).where(col("value").rlike(r"\S")).limit(count)
    return [r["value"] for r in head.collect()]


def resolve(spark: SparkSession, path: str | Sequence[str], layout: Layout) -> tuple[Layout, list[list[str]]]:
    """Fill in the undetermined parts of a layout from a sample."""
    sample = sample_lines(spark, path)
    sep = layout.sep or detect.sniff(sample)
    if layout.sep == "auto":
        sep = detect.delimiter(sample[0]) if sample else ","
    rows = detect.split_lines(sample, sep)
    if not rows:
        raise ValueError(f"no data found in {path}")
    header = detect.has_header(rows) if layout.header is None else layout.header
    kv = detect.is_key_value(rows, header) if layout.kv is None else layout.kv
    return replace(layout, header=header, kv=kv, sep=sep), rows


def numbered_lines(
    spark: SparkSession, path: str | Sequence[str], header: bool, sep: str = ",", multi_line: bool = False, file: bool = False
) -> DataFrame:
    """Non-blank data lines with their row number from 1, and their file if wanted; each file's header line is left out.

    With ``multi_line`` a line goes on while a quote is open.
    """
    if multi_line:
        blank = lambda value: ~not_blank(value, split_cells(value, sep), sep)
        records = quoted_records(spark, path, blank, skip_per_file=1 if header else 0)
        return records if file else records.drop(FILE)
    tagged = tag_splits(_lines(spark, path))
    if file:
        tagged = tagged.withColumn(FILE, col("__file"))
    kept = tagged.where(not_blank(col("value"), split_cells(col("value"), sep), sep))
    return number_rows(kept, skip_per_file=1 if header else 0)


def load_flat(spark: SparkSession, path: str | Sequence[str], layout: Layout = Layout(), *, multi_line: bool = False) -> DataFrame:
    """All-text table from flat rows, with row lineage; ``multi_line`` allows line breaks in quotes, in split files too."""
    layout, rows = resolve(spark, path, replace(layout, kv=False))
    lines = numbered_lines(spark, path, layout.header, layout.sep, multi_line)
    if layout.col_names:
        names = list(layout.col_names)
    elif layout.header:
        names = [cell.strip() for cell in rows[0]]
    else:
        width = lines.agg(F.max(F.size(split_cells(col("value"), layout.sep)))).first()[0]
        names = [f"col_{i}" for i in range(width)]
    return parse_flat(lines, names, sep=layout.sep)


def load_key_value(spark: SparkSession, path: str | Sequence[str], layout: Layout = Layout(), *, multi_line: bool = False) -> DataFrame:
    """All-text table from key:value rows, one column per key, with row lineage; ``multi_line`` as in ``load_flat``."""
    layout, _ = resolve(spark, path, replace(layout, kv=True))
    rows = kv_rows(numbered_lines(spark, path, layout.header, layout.sep, multi_line), sep=layout.sep)
    return project_keys(rows, discover_keys(rows, sep=layout.sep), layout.sep)


#: Entries of a row's rescued cells that name no column: the cells beyond the last column, and how many are missing.
SURPLUS, MISSING, RESCUED = "_surplus", "_missing", "_rescued"


def load_rescued(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, layout: Layout = Layout(), *, multi_line: bool = False
) -> DataFrame:
    """Typed flat rows in which nothing that does not fit is lost: row number, file and ``_rescued`` beside the columns.

    ``_rescued`` maps a column to the text that could not be read as its type, ``_surplus`` to the cells beyond the last column
    (as JSON) and ``_missing`` to the number of columns that a short row lacks; it is NULL for a row that fits.  Such a cell
    is NULL in its column.
    """
    layout, _ = resolve(spark, path, replace(layout, kv=False))
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    lines = numbered_lines(spark, path, layout.header, layout.sep, multi_line, file=True)
    cells = lines.select(split_cells(col("value"), layout.sep).alias("__cells"), ROW, FILE)
    trimmed = cells.select(F.transform("__cells", lambda c: F.nullif(strip(c), F.lit(""))).alias("__cells"), ROW, FILE)
    width = len(schema)
    text_at = lambda i: F.get(col("__cells"), F.lit(i))
    read = trimmed.select("*", *[text_at(i).try_cast(f.dataType).alias(f"__v{i}") for i, f in enumerate(schema)])

    def entry(key: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))

    extra = F.slice(col("__cells"), width + 1, F.greatest(F.size("__cells") - width, F.lit(0)))
    wrong = [entry(f.name, text_at(i), text_at(i).isNotNull() & col(f"__v{i}").isNull()) for i, f in enumerate(schema)]
    wrong.append(entry(SURPLUS, F.to_json(extra), F.exists(extra, lambda c: c.isNotNull())))
    wrong.append(entry(MISSING, (F.lit(width) - F.size("__cells")).cast("string"), F.size("__cells") < width))
    found = F.array_compact(F.array(*wrong))
    marked = read.select("*", found.alias("__wrong"))
    rescued = F.when(F.size("__wrong") > 0, F.map_from_entries("__wrong")).alias(RESCUED)
    return marked.select(*[col(f"__v{i}").alias(f.name) for i, f in enumerate(schema)], rescued, FILE, ROW)


def malformed_counts(rescued: DataFrame) -> DataFrame:
    """Rows of each file, rows that did not fit, and of these those with unread, surplus and missing cells."""
    wrong = F.map_keys(RESCUED)
    has = lambda key: F.coalesce(F.array_contains(wrong, key), F.lit(False))
    unread = F.coalesce(F.exists(wrong, lambda k: ~k.isin(SURPLUS, MISSING)), F.lit(False))
    return rescued.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(col(RESCUED).isNotNull()).alias("malformed"),
        F.count_if(unread).alias("unread"),
        F.count_if(has(SURPLUS)).alias("surplus"),
        F.count_if(has(MISSING)).alias("missing"),
    )


def load_or_text(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, layout: Layout = Layout(), *, malformed: int = 0, multi_line: bool = False
) -> DataFrame:
    """The typed table if at most ``malformed`` rows do not fit the schema, else all columns as text, named as in the schema."""
    rescued = load_rescued(spark, path, schema, layout, multi_line=multi_line)
    names = [c for c in rescued.columns if c not in (RESCUED, FILE, ROW)]
    if rescued.where(col(RESCUED).isNotNull()).limit(malformed + 1).count() <= malformed:
        return rescued.select(*names, ROW)
    return load_flat(spark, path, replace(layout, col_names=tuple(names)), multi_line=multi_line)


def load_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    layout: Layout = Layout(),
    *,
    schema: str | T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Typed table from CSV, with row lineage.

    Types are inferred from the whole input unless ``schema`` is given (which
    saves a pass).  Integers widen to bigint; timestamps have no zone.
    """
    layout, _ = resolve(spark, path, replace(layout, kv=False))
    reader = spark.read.options(header=layout.header, sep=layout.sep, escape='"', multiLine=multi_line)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    scan = reader.csv([path] if isinstance(path, str) else list(path))
    names = list(scan.columns) if layout.header else [f"col_{i}" for i in range(len(scan.columns))]
    given = list(layout.col_names or [])[: len(names)]
    names = given + names[len(given) :]
    widen = {"int": "bigint", "timestamp": "timestamp_ntz"}
    typed = [
        (c.cast(widen[kind]) if kind in widen and not schema else c).alias(name)
        for name, (c, kind) in zip(names, [(col(old), kind) for old, kind in scan.dtypes])
    ]
    return number_rows(tag_splits(scan)).select(*typed, ROW)
