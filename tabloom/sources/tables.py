"""Load files as named tables."""
from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.cells import business_columns
from . import text

FORMATS = {"flat": "flat CSV", "kv": "key:value", "parquet": "parquet"}


@dataclass
class Table:
    """A loaded table and what is known about its source.  The row count is taken on demand."""

    name: str
    df: DataFrame
    source: str = ""
    header: bool = False
    format: str = "flat"

    @property
    def columns(self) -> list[str]:
        return business_columns(self.df)

    def info(self) -> dict:
        return {
            "source": self.source,
            "header": self.header,
            "format": FORMATS[self.format],
            "rows": self.df.count(),
            "columns": self.columns,
            "table": self.name,
        }


def split_spec(spec: str) -> tuple[str, str | None]:
    """``path:table`` as (path, table); a path that exists as written has no table part."""
    if os.path.exists(spec) or ":" not in spec:
        return spec, None
    path, _, name = spec.rpartition(":")
    if not path or not re.fullmatch(r"\w+", name):
        return spec, None
    return path, name


def table_name(path: str) -> str:
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return re.sub(r"\W+", "_", stem)


def _holds_parquet(spark: SparkSession, path: str) -> bool:
    """Whether the files below a path without a suffix are Parquet files."""
    files = spark.read.text(path).inputFiles()
    return bool(files) and all(f.endswith((".parquet", ".pq")) for f in files)


def read_table(
    spark: SparkSession,
    path: str,
    *,
    name: str | None = None,
    header: bool | None = None,
    kv: bool | None = None,
    col_names: Sequence[str] | None = None,
    sep: str | None = None,
    typed: bool = True,
    schema: str | T.StructType | None = None,
    multi_line: bool = False,
    format: str | None = None,
) -> Table:
    """Load one path: Parquet by its suffix or its files', tab-separated for .tsv, otherwise delimited text.

    ``format`` ("parquet" or "text") decides instead of the names.  Flat text is typed by default; ``typed=False``
    keeps every column as text.  Options that a layout cannot honour are errors.
    """
    if format not in (None, "parquet", "text"):
        raise ValueError("format is parquet or text")
    name = name or table_name(path)
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if format == "parquet" or format is None and (suffix in (".parquet", ".pq") or not suffix and _holds_parquet(spark, path)):
        return Table(name, spark.read.parquet(path), path, True, "parquet")
    layout = text.Layout(header, kv, tuple(col_names) if col_names else None, sep or ("\t" if suffix == ".tsv" else None))
    layout, _ = text.resolve(spark, path, layout)
    if schema is not None and (layout.kv or not typed):
        raise ValueError("a schema needs flat typed rows")
    if layout.kv:
        df = text.load_key_value(spark, path, layout, multi_line=multi_line)
    elif typed:
        df = text.load_csv(spark, path, layout, schema=schema, multi_line=multi_line)
    else:
        df = text.load_flat(spark, path, layout, multi_line=multi_line)
    return Table(name, df, path, layout.header, "kv" if layout.kv else "flat")


def read_tables(spark: SparkSession, specs: Sequence[str], *, table: str | None = None, **options) -> dict[str, Table]:
    """Load several paths as tables named by mapping or file stem; names must differ."""
    tables: dict[str, Table] = {}
    for spec in specs:
        path, name = split_spec(spec)
        if name is None and table and len(specs) == 1:
            name = table
        loaded = read_table(spark, path, name=name, **options)
        if loaded.name in tables:
            raise ValueError(f"two inputs map to table {loaded.name!r}; use path:table to name them")
        tables[loaded.name] = loaded
    return tables
