"""A data source for SQLite token caches: split tables are read by ranges of their key."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.key = options["path"], options["table"], options.get("key", "rowid")
        self.parts, self.names = int(options.get("partitions", "4")), schema.names
        for name in (self.table, self.key, *self.names):
            if not name.replace("_", "").isalnum():
                raise ValueError(f"not a plain name: {name}")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[_Range]:
        with self._open() as db:
            low, high = db.execute(f"SELECT min({self.key}), max({self.key}) FROM {self.table}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with self._open() as db:
            yield from db.execute(f"SELECT {', '.join(self.names)} FROM {self.table} WHERE {self.key} >= ? AND {self.key} < ?", (part.low, part.high))


class SQLiteSource(DataSource):
    """Options: path (on a folder that all executors see), table, key (an integer column), partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SQLiteSource)
