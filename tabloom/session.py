"""The table API: a catalog of named DataFrames with one active table."""
from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import staging
from .functions.cells import sql_name
from .operators import aggregate as agg
from .operators import filters, pivot, profile
from .operators.reconcile import Plan, reconcile
from .plans import analyses
from .sinks import files
from .sources.tables import Table, read_tables

Parameters = Sequence | Mapping | None


class Workbench:
    """Loaded tables as temp views, queried with Spark SQL or the methods below.

    Methods return lazy DataFrames.  The last result of a query, aggregate, pivot, analysis or comparison is
    kept as ``last_result`` with ``last_query`` and ``last_action``.
    """

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or staging.session()
        self.tables: dict[str, Table] = {}
        self.active: str | None = None
        self.last_result: DataFrame | None = None
        self.last_query: str | None = None
        self.last_action: str | None = None

    # Tables

    def load(self, *specs: str, table: str | None = None, **options) -> Workbench:
        """Load files (``path`` or ``path:table``); the first becomes the active table."""
        for loaded in read_tables(self.spark, specs, table=table, **options).values():
            self._add(loaded)
        return self

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame available under a table name."""
        self._add(Table(name, df, source="frame", format="parquet"))

    def unregister(self, name: str) -> None:
        self.tables.pop(name, None)
        self.spark.catalog.dropTempView(name)
        if self.active == name:
            self.active = next(iter(self.tables), None)

    def _add(self, loaded: Table) -> None:
        self.tables[loaded.name] = loaded
        loaded.df.createOrReplaceTempView(sql_name(loaded.name))
        self.active = self.active or loaded.name

    def get_tables(self) -> list[str]:
        return list(self.tables)

    def show_tables(self) -> DataFrame:
        return self.spark.sql("SHOW TABLES")

    def set_active_table(self, table: str) -> None:
        if table not in self.tables:
            raise ValueError(f"table {table!r} is not loaded")
        self.active = table

    def frame(self, table: str | None = None) -> DataFrame:
        """A loaded table, or any view by name; the active table by default."""
        name = table or self.active
        if name is None:
            raise ValueError("no table is loaded")
        return self.tables[name].df if name in self.tables else self.spark.table(sql_name(name))

    @property
    def columns(self) -> list[str]:
        return self.tables[self.active].columns

    # Metadata

    def info(self) -> dict:
        return self.tables[self.active].info()

    def preview(self, n: int = 10) -> DataFrame:
        return profile.preview(self.frame(), n)

    def schema(self) -> DataFrame:
        return profile.schema_table(self.frame())

    def coverage(self) -> DataFrame:
        return profile.coverage(self.frame())

    def summarize(self, **options) -> DataFrame:
        return profile.summarize(self.frame(), **options)

    # Queries

    def _keep(self, result: DataFrame, action: str, query: str | None = None) -> DataFrame:
        self.last_result, self.last_action, self.last_query = result, action, query
        return result

    def sql(self, query: str, parameters: Parameters = None) -> DataFrame:
        """Spark SQL over the tables; ``?`` markers bind a list, ``:name`` markers a dict."""
        args = parameters if parameters is None or isinstance(parameters, Mapping) else list(parameters)
        return self._keep(self.spark.sql(query, args=args), "SQL Query", query)

    def filter(self, where: str, parameters: Parameters = None) -> DataFrame:
        return self.sql(f"SELECT * FROM {sql_name(self.active)} WHERE {where}", parameters)

    def create_view(self, name: str, where: str) -> None:
        """A named filtered view of the active table; replaces a view of that name."""
        self.frame().where(where).createOrReplaceTempView(sql_name(name))

    def add_column(self, name: str, expression: str, source: str | None = None, parameters: Parameters = None) -> None:
        """Add or replace a derived text column of a loaded table."""
        target = source or self.active
        df = self.frame(target)
        if parameters is None:
            changed = filters.add_column(df, name, expression)
        else:
            kept = ", ".join(sql_name(c) for c in df.columns if c != name)
            args = parameters if isinstance(parameters, Mapping) else list(parameters)
            changed = self.spark.sql(
                f"SELECT {kept}, CAST(({expression}) AS STRING) AS {sql_name(name)} FROM {sql_name(target)}", args=args
            )
        self._replace(target, changed)

    def aggregate(
        self, group_by: str | Sequence[str], field: str, func: str = "SUM", source: str | None = None
    ) -> DataFrame:
        return self._keep(agg.aggregate(self.frame(source), group_by, field, func), "Aggregate")

    def pivot(self, row_key: str, col_key: str, value: str, func: str = "SUM", source: str | None = None) -> DataFrame:
        return self._keep(pivot.pivot(self.frame(source), row_key, col_key, value, func), "Pivot")

    def auto_chart(self) -> tuple[str, DataFrame]:
        """Chart kind and data for the last result, or for the active table."""
        return agg.auto_chart(self.last_result if self.last_result is not None else self.frame())

    def chart(self, kind: str, x: str | None = None, y: str | None = None, **options) -> DataFrame:
        source = self.last_result if self.last_result is not None else self.frame()
        return agg.chart_data(source, kind, x, y, **options)

    # Saved queries

    def saved_query(self, name: str, **names: str) -> DataFrame:
        """Run a query of the library on the active table, with column names filled in."""
        template = analyses.SAVED_QUERIES[name]
        wanted = set(re.findall(r"\{(\w+)\}", template)) - {"table"}
        if wanted - names.keys():
            raise ValueError(f"query {name!r} needs {sorted(wanted - names.keys())}")
        filled = {k: sql_name(v) for k, v in names.items()}
        return self.sql(template.format(table=sql_name(self.active), **filled))

    # Analyses

    def run(self, *names: str, **roles: str) -> dict[str, dict[str, DataFrame]]:
        """Run named analyses in order on the active table; unknown names are reported and skipped.

        ``roles`` (see ``analyses.ROLES``) name columns, and every analysis takes the same ones.  Columns and views
        made earlier are visible to later analyses.
        """
        unknown = roles.keys() - set(analyses.ROLES)
        if unknown:
            raise ValueError(f"unknown roles {sorted(unknown)}; use some of {analyses.ROLES}")
        results: dict[str, dict[str, DataFrame]] = {}
        for name in names:
            if name not in analyses.ANALYSES:
                warnings.warn(f"no analysis is named {name!r}", stacklevel=2)
                continue
            results[name] = analyses.ANALYSES[name](self.frame(), **roles)
            for kind, result in results[name].items():
                if kind == analyses.NEW_TABLE:
                    self._replace(self.active, result)
                self._keep(result, name)
        return results

    def _replace(self, name: str, df: DataFrame) -> None:
        base = self.tables.get(name) or Table(name, df, source="view", format="parquet")
        self._add(Table(name, df, base.source, base.header, base.format))

    def reconcile(self, plan: Plan, left: str | None = None, right: str | None = None, **orders) -> dict[str, DataFrame]:
        """Compare two tables by key: the named ones, else ``source_db`` and ``target_db``, else the first two loaded."""
        if left is None or right is None:
            pair = ["source_db", "target_db"]
            if not all(name in self.tables for name in pair):
                pair = self.get_tables()[:2]
            if len(pair) < 2:
                raise ValueError("two tables are needed; load both sides first")
            left, right = left or pair[0], right or pair[1]
        results = reconcile(self.frame(left), self.frame(right), plan, **orders)
        self._keep(results["results"], "reconcile")
        return results

    # Export

    def export(self, path: str, format: str = "csv", query: str | None = None, mode: str = "error") -> None:
        """Write a query's result, or the active table."""
        files.export(self.spark.sql(query) if query else self.frame(), path, format, mode)

    def export_csv(self, path: str, query: str | None = None) -> None:
        self.export(path, "csv", query)

    def export_json(self, path: str, query: str | None = None) -> None:
        self.export(path, "json", query)

    def export_parquet(self, path: str, query: str | None = None) -> None:
        self.export(path, "parquet", query)

    def export_last(self, path: str, format: str = "csv", mode: str = "error") -> None:
        if self.last_result is None:
            raise ValueError("there is no result to export")
        files.export(self.last_result, path, format, mode)
