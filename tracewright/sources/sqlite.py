"""SQLite tables as a Spark data source; rows are read in ranges of rowid, one partition each."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path, table, prefix_column and prefix (only keys that begin so), partitions. Values are cast to strings where
    the schema says so, blobs read as UTF-8 with bad bytes left out."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            names = [r[1] for r in db.execute(f'PRAGMA table_info("{_name(self.options["table"])}")')]
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def _name(raw: str) -> str:
    if not raw.replace("_", "").isalnum():
        raise ValueError(f"no plain table or column name: {raw}")
    return raw


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = [(f.name, f.dataType.simpleString()) for f in schema.fields], options

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{_name(self.options["table"])}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        n = int(self.options.get("partitions", 4))
        step = -(-(high + 1 - low) // n)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(f'"{name}"' for name, _ in self.fields)
        sql, values = f'SELECT {columns} FROM "{_name(self.options["table"])}" WHERE rowid >= ? AND rowid < ?', [partition.low, partition.high]
        if "prefix" in self.options:
            sql, values = sql + f' AND substr("{_name(self.options["prefix_column"])}", 1, ?) = ?', [*values, len(self.options["prefix"]), self.options["prefix"]]
        with self._open() as db:
            for row in db.execute(sql + " ORDER BY rowid", values):
                yield tuple(_cast(v, kind) for v, (_, kind) in zip(row, self.fields, strict=True))


def _cast(value, kind: str):
    if value is None or kind != "string":
        return value
    return value.decode("utf-8", "ignore") if isinstance(value, bytes) else str(value)
