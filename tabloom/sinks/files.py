"""Write results as directories of part files, in parallel."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

FORMATS = ("csv", "json", "parquet")

# The text formats keep microseconds; Spark's defaults cut them to milliseconds.
_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(header=True, escape='"', **_TIMES).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON Lines, NULL fields included."""
    df.write.mode(mode).options(ignoreNullFields=False, **_TIMES).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def export(df: DataFrame, path: str, format: str = "csv", mode: str = "error") -> None:
    """Write in a format named in any letter case."""
    writers = {"csv": write_csv, "json": write_json, "parquet": write_parquet}
    try:
        write = writers[format.lower()]
    except KeyError:
        raise ValueError(f"unsupported format {format!r}; use one of {FORMATS}") from None
    write(df, path, mode)


def export_all(results: Mapping[str, DataFrame], folder: str, format: str = "csv", mode: str = "error") -> dict[str, str]:
    """Write each result below ``folder`` under its own name; returns the paths."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in results}
    for name, df in results.items():
        export(df, paths[name], format, mode)
    return paths


def write_reconciliation(results: Mapping[str, DataFrame], folder: str, mode: str = "error") -> dict[str, str]:
    """The full comparison and the rows that are not OK, as CSV; both read the staged comparison."""
    return export_all(
        {"full_comparison_results": results["results"], "mismatch-only": results["not_ok"]}, folder, "csv", mode
    )
