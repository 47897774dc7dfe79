"""Writing to SQLite: tables created and filled by Spark tasks in one transaction, rows deleted by conditions.

A database is one file with one writer. Tasks therefore stage their rows beside it, and the commit, which runs where the driver is, puts
all of them into the file in one transaction, as a stream; a job that fails leaves the file as it was.
"""

from __future__ import annotations

import os
import pickle
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: SQLite's types by Spark's; others are kept as text.
TYPES = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
OPERATORS = ("=", "<>", "<", "<=", ">", ">=")
#: Rows of a staged chunk.
CHUNK = 1000


def _name(raw: str) -> str:
    if not raw.replace("_", "").isalnum():
        raise ValueError(f"no plain table or column name: {raw}")
    return f'"{raw}"'


def _creation(table: str, columns: dict[str, str], primary_key: Sequence[str]) -> str:
    if bad := set(columns.values()) - set(TYPES.values()):
        raise ValueError(f"no types of SQLite: {bad}")
    parts = [f"{_name(c)} {kind}" for c, kind in columns.items()]
    if primary_key:
        parts.append(f"PRIMARY KEY ({', '.join(map(_name, primary_key))})")
    return f"CREATE TABLE IF NOT EXISTS {_name(table)} ({', '.join(parts)})"


def create(path: str, table: str, columns: dict[str, str], primary_key: Sequence[str] = ()) -> None:
    """Makes the table with its columns (name to SQLite type) unless it is there."""
    with sqlite3.connect(path) as db:
        db.execute(_creation(table, columns, primary_key))


def delete(path: str, table: str, conditions: Sequence[tuple[str, str, object]]) -> int:
    """Deletes the rows that meet all conditions (column, operator, value) and returns how many; clear() is for all rows."""
    if not conditions:
        raise ValueError("no condition")
    if bad := [op for _, op, _ in conditions if op not in OPERATORS]:
        raise ValueError(f"no operator of a condition: {bad[0]}")
    where = " AND ".join(f"{_name(c)} {op} ?" for c, op, _ in conditions)
    with sqlite3.connect(path) as db:
        return db.execute(f"DELETE FROM {_name(table)} WHERE {where}", [v for _, _, v in conditions]).rowcount


def clear(path: str, table: str) -> int:
    with sqlite3.connect(path) as db:
        return db.execute(f"DELETE FROM {_name(table)}").rowcount


@dataclass
class _Staged(WriterCommitMessage):
    path: str


class SqliteSink(DataSource):
    """Options: path, table, primary_key (columns parted by commas, for a table that is made). The path's folder is shared between the
    tasks and the driver. mode append adds rows, overwrite replaces all of them."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_sink"

    def schema(self) -> str:
        raise NotImplementedError("this source is only written to")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, dict(self.options), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.columns = {f.name: TYPES.get(f.dataType.simpleString(), "TEXT") for f in schema.fields}
        self.path, self.table, self.overwrite = options["path"], options["table"], overwrite
        self.key = [c for c in options.get("primary_key", "").split(",") if c]
        self.folder = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Staged:
        """A task's rows in a file of their own; a second attempt writes another one."""
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with open(path, "wb") as f:
            while chunk := [tuple(_stored(v) for v in row) for row in islice(iterator, CHUNK)]:
                pickle.dump(chunk, f)
        return _Staged(path)

    def commit(self, messages: list[_Staged | None]) -> None:
        places = ", ".join("?" * len(self.columns))
        db = sqlite3.connect(self.path, isolation_level=None)
        try:
            db.execute("BEGIN IMMEDIATE")
            db.execute(_creation(self.table, self.columns, self.key))
            if self.overwrite:
                db.execute(f"DELETE FROM {_name(self.table)}")
            for m in messages:
                if m is not None:
                    db.executemany(f"INSERT INTO {_name(self.table)} ({', '.join(map(_name, self.columns))}) VALUES ({places})", _chunks(m.path))
            db.execute("COMMIT")
        finally:
            db.close()  # what is not committed is rolled back
            self._unstage()

    def abort(self, messages: list[_Staged | None]) -> None:
        self._unstage()

    def _unstage(self) -> None:
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                os.remove(f"{self.folder}/{name}")
            os.rmdir(self.folder)


def _chunks(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield from pickle.load(f)  # noqa: S301  written by this job's own tasks
            except EOFError:
                return


def _stored(value: object) -> object:
    if value is None or isinstance(value, (int, float, str)):
        return value
    return bytes(value) if isinstance(value, (bytes, bytearray)) else str(value)


def write(rows: DataFrame, path: str, table: str, mode: str = "append", primary_key: Sequence[str] = ()) -> None:
    """Writes rows to the table, which is made where it is not there; column names are plain ones."""
    for c in [table, *rows.columns]:
        _name(c)
    rows.sparkSession.dataSource.register(SqliteSink)
    rows.write.format("sqlite_sink").option("path", path).option("table", table).option("primary_key", ",".join(primary_key)).mode(mode).save()
