"""A session: tables by name, SQL in, DataFrames out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from larkspur.functions.types import EngineError
from larkspur.operators.relational import union_scan
from larkspur.plans.parser import CreateTable, parse
from larkspur.plans.planner import plan
from larkspur.sources.catalog import Catalog, TableInfo
from larkspur.sources.tables import append, compact, layout, scan, statistics, store
from larkspur.sources.text import read_text, write_text


class Session:
    """directory: where tables of CREATE TABLE are stored; catalog: the file that remembers them."""

    def __init__(self, spark: SparkSession, directory: str | None = None, catalog: str | None = None):
        self.spark, self.directory = spark, directory
        self.catalog = Catalog.open(catalog, spark) if catalog else Catalog("")
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame known to SQL, for this session."""
        self.frames[name] = df

    def tables(self, names: Sequence[str]) -> DataFrame:
        """The rows of several tables of one schema, one table after the other."""
        return union_scan([self.table(n) for n in names])

    def table(self, name: str) -> DataFrame:
        return self.frames[name] if name in self.frames else scan(self.spark, self.catalog.table(name))

    def sql(self, source: str, names: Sequence[str] | None = None) -> DataFrame | None:
        """The DataFrame of a SELECT; None for a CREATE TABLE. names: of the output columns."""
        statement = parse(source)
        if isinstance(statement, CreateTable):
            self.create(statement)
            return None
        return plan(statement, self.table, names)

    def create(self, statement: CreateTable) -> TableInfo:
        if self.directory is None:
            raise EngineError("the session has no directory for tables")
        if statement.name in self.frames:
            raise EngineError(f"table {statement.name!r} exists")
        columns = [(n, t.name) for n, t in statement.columns]
        table = TableInfo(statement.name, f"{self.directory.rstrip('/')}/{statement.name}", columns, statement.order_by)
        self.catalog.add(table)
        self._save()
        return table

    def load(self, name: str, path: str) -> int:
        """Replaces a table's rows by a text file's, and its statistics; gives the number of rows."""
        table = self.catalog.table(name)
        store(read_text(self.spark, path, table.schema), table)
        self._count(table)
        return table.tuple_count

    def append(self, name: str, rows: DataFrame) -> int:
        table = self.catalog.table(name)
        append(self.spark, rows, table)
        self._count(table)
        return table.tuple_count

    def compact(self, name: str) -> None:
        """One order of all rows, after appends to an ordered table."""
        compact(self.spark, self.catalog.table(name))

    def layout(self, name: str) -> DataFrame:
        return layout(self.spark, self.catalog.table(name))

    def dump(self, name: str, path: str) -> None:
        write_text(self.table(name), path)

    def _count(self, table: TableInfo) -> None:
        table.tuple_count, table.distinct_counts = statistics(scan(self.spark, table))
        self._save()

    def _save(self) -> None:
        if self.catalog.path:
            self.catalog.save()

    def close(self) -> None:
        self._save()
