"""The catalog: keys with a string, a list of strings or an int, and tables among them; one JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from larkspur.functions.types import NAMES, EngineError, Schema


@dataclass
class TableInfo:
    """What is known of a table. order_by: the column it is stored in the order of. Counts are None until loaded."""

    name: str
    path: str
    columns: list[tuple[str, str]]
    order_by: str | None = None
    tuple_count: int = 0
    distinct_counts: dict[str, int] | None = None

    @property
    def schema(self) -> Schema:
        return [(n, NAMES[t]) for n, t in self.columns]

    @property
    def file_type(self) -> str:
        return "ordered" if self.order_by else "heap"


@dataclass
class Catalog:
    path: str
    entries: dict = field(default_factory=dict)
    tables: dict[str, TableInfo] = field(default_factory=dict)

    spark: SparkSession | None = field(default=None, repr=False, compare=False)

    @classmethod
    def open(cls, path: str, spark: SparkSession | None = None) -> Catalog:
        """path: of this machine or, with a session, of any file system it knows (scheme://...)."""
        found = cls(path, spark=spark if "://" in path else None)
        held = found._read()
        if held is not None:
            held = json.loads(held)
            found.entries = held["entries"]
            found.tables = {n: TableInfo(**{**t, "columns": [tuple(c) for c in t["columns"]]}) for n, t in held["tables"].items()}
        return found

    def _remote(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self) -> str | None:
        if self.spark is None:
            if not os.path.exists(self.path):
                return None
            with open(self.path, encoding="utf-8") as f:
                return f.read()
        at, fs = self._remote(self.path)
        if not fs.exists(at):  # a save cut short leaves the new file
            at, _ = self._remote(f"{self.path}.new")
            if not fs.exists(at):
                return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def save(self) -> None:
        """All at once: a reader sees the old file or the new."""
        text = json.dumps({"entries": self.entries, "tables": {n: asdict(t) for n, t in self.tables.items()}}, indent=1)
        if self.spark is None:
            with open(f"{self.path}.new", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(f"{self.path}.new", self.path)
            return
        (at, fs), (new, _) = self._remote(self.path), self._remote(f"{self.path}.new")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.delete(at, False)
        fs.rename(new, at)

    def put(self, key: str, value: str | int | list[str]) -> None:
        self.entries[key] = value

    def _get(self, key: str, kind: type):
        value = self.entries.get(key)
        if value is not None and (not isinstance(value, kind) or isinstance(value, bool)):
            raise EngineError(f"{key!r} holds no {kind.__name__}")
        return value

    def get_string(self, key: str) -> str | None:
        return self._get(key, str)

    def get_strings(self, key: str) -> list[str] | None:
        return self._get(key, list)

    def get_int(self, key: str) -> int | None:
        return self._get(key, int)

    def add(self, table: TableInfo) -> None:
        names = [n for n, _ in table.columns]
        if len(set(names)) < len(names):
            raise EngineError(f"table {table.name!r} has a column twice")
        if table.order_by is not None and table.order_by not in names:
            raise EngineError(f"table {table.name!r} has no column {table.order_by!r} to be ordered by")
        if table.name in self.tables:
            raise EngineError(f"table {table.name!r} exists")
        self.tables[table.name] = table

    def table(self, name: str) -> TableInfo:
        if name not in self.tables:
            raise EngineError(f"no table {name!r}")
        return self.tables[name]
