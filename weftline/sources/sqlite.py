"""SQLite files as a source that takes filters, and as a sink that commits once.

Tasks write their rows to files beside the database; the commit takes them in, in
one transaction.  A write that fails leaves the database as it was.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualNullSafe: "IS"}
KINDS = {"INT": "bigint", "BIG": "bigint", "REA": "double", "FLO": "double", "DOU": "double", "BLO": "binary"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """A table of a SQLite file, by ranges of its row numbers."""

    @classmethod
    def name(cls) -> str:
        return "weftline_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{r[1]}` {KINDS.get((r[2] or 'TEXT').upper()[:3], 'string')}" for r in rows)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(dict(self.options), schema, overwrite)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.where: list[str] = []
        self.values: list[Any] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of numbers and texts go into the statement; what SQLite may see otherwise is left to Spark."""
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in COMPARED else []
            plain = name in kinds and isinstance(kinds[name], (T.LongType, T.DoubleType, T.StringType)) and all(isinstance(v, (int, float, str)) and isinstance(v, str) == isinstance(kinds[name], T.StringType) for v in values)
            if not plain or not (type(f) in COMPARED or isinstance(f, (In, IsNull, IsNotNull))):
                yield f
                continue
            if isinstance(f, In):
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(values))})")
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                self.where.append(f"{quoted(name)} {COMPARED[type(f)]} ?")
            self.values += values

    def statement(self) -> str:
        names = ", ".join(map(quoted, self.schema.names))
        return f"SELECT {names} FROM {quoted(self.options['table'])} WHERE " + " AND ".join([*self.where, "rowid >= ? AND rowid < ?"])

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
        step = int(self.options.get("rows", 1_000_000))
        return [_Rows(at, at + step) for at in range(low, high + 1, step)] if low is not None else [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            yield from c.execute(self.statement(), [*self.values, partition.low, partition.high])


@dataclass
class Staged(WriterCommitMessage):
    path: str
    rows: int


class SqliteWriter(DataSourceWriter):
    """Rows by their ``_op``: ``put`` replaces the rows of its keys, ``delete`` removes them, null only adds."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.options, self.overwrite, self.run = options, overwrite, uuid.uuid4().hex[:8]
        self.columns = [f for f in schema if f.name != "_op"]
        self.names = schema.names
        self.keys = [k for k in options.get("keys", "").split(",") if k]

    def write(self, iterator: Iterator[tuple]) -> Staged:
        context = TaskContext.get()
        path = f"{self.options['path']}.stage-{self.run}-{context.partitionId()}-{context.taskAttemptId()}"
        staged, n = sqlite3.connect(path), 0
        with staged:
            staged.execute(f"CREATE TABLE rows ({', '.join(map(quoted, self.names))})")
            marks = ", ".join("?" * len(self.names))

            def counted() -> Iterator[tuple]:
                nonlocal n
                for row in iterator:
                    n += 1
                    yield tuple(row)

            staged.executemany(f"INSERT INTO rows VALUES ({marks})", counted())
        staged.close()
        return Staged(path, n)

    def _type(self, kind: T.DataType) -> str:
        return "INTEGER" if isinstance(kind, (T.LongType, T.BooleanType)) else "REAL" if isinstance(kind, T.DoubleType) else "BLOB" if isinstance(kind, T.BinaryType) else "TEXT"

    def _gathered(self, target: sqlite3.Connection, paths: list[str]) -> None:
        """The staged rows of all tasks in the first one's file, attached as ``weftline_staged``: SQLite moves them itself, and only one more file is open at a time."""
        target.execute("ATTACH ? AS weftline_staged", paths[:1])
        target.execute("PRAGMA weftline_staged.journal_mode = OFF")
        target.execute("PRAGMA weftline_staged.synchronous = OFF")
        for path in paths[1:]:
            target.execute("ATTACH ? AS weftline_next", [path])
            target.execute("INSERT INTO weftline_staged.rows SELECT * FROM weftline_next.rows")
            target.execute("DETACH weftline_next")
            os.remove(path)

    def _remove(self, target: sqlite3.Connection) -> None:
        """The rows of all changed keys go in one pass over the table, or one for each set of keys that are null together.

        The keys lie in a sorted temporary table with the types of the target's columns.  ``IN`` compares as the target's columns do
        and looks up in an index, whatever SQLite expects of the sizes; of nulls it finds none, so these are asked for by name.
        """
        table, keys = f"main.{quoted(self.options['table'])}", list(map(quoted, self.keys))
        target.execute(f"CREATE TEMP TABLE weftline_gone AS SELECT {', '.join(keys)} FROM {table} WHERE 0")
        target.execute(f"INSERT INTO temp.weftline_gone SELECT {', '.join(keys)} FROM weftline_staged.rows WHERE _op IS NOT NULL")
        target.execute(f"CREATE INDEX temp.weftline_gone_keys ON weftline_gone ({', '.join(keys)})")
        for nulls in target.execute(f"SELECT DISTINCT {', '.join(f'{k} IS NULL' for k in keys)} FROM temp.weftline_gone").fetchall():
            same = [k for k, null in zip(keys, nulls, strict=True) if not null]
            tests = " AND ".join(f"{k} IS {'NOT ' * (not null)}NULL" for k, null in zip(keys, nulls, strict=True))
            among = f" AND ({', '.join(same)}) IN (SELECT {', '.join(same)} FROM temp.weftline_gone WHERE {tests})" if same else ""
            target.execute(f"DELETE FROM {table} WHERE {tests}{among}")

    def commit(self, messages: list[Staged | None]) -> None:
        table, paths = f"main.{quoted(self.options['table'])}", [m.path for m in messages if m is not None]
        target = sqlite3.connect(self.options["path"], isolation_level=None)
        try:
            if paths:
                self._gathered(target, paths)
            with target:  # one transaction
                target.execute("BEGIN IMMEDIATE")
                target.execute(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'{quoted(f.name)} {self._type(f.dataType)}' for f in self.columns)})")
                if self.overwrite:
                    target.execute(f"DELETE FROM {table}")
                if paths and self.keys:
                    self._remove(target)
                if paths:
                    names, where = ", ".join(quoted(f.name) for f in self.columns), " WHERE _op IS NOT 'delete'" if "_op" in self.names else ""
                    target.execute(f"INSERT INTO {table} ({names}) SELECT {names} FROM weftline_staged.rows{where}")
        finally:
            target.close()
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_sqlite(spark: SparkSession, options: dict, table: str) -> DataFrame:
    _registered(spark)
    reader = spark.read.format("weftline_sqlite").option("path", options["path"]).option("table", table)
    return (reader.option("rows", options["rows"]) if "rows" in options else reader).load()


def exists(options: dict, table: str) -> bool:
    if not os.path.exists(options["path"]):
        return False
    with sqlite3.connect(f"file:{options['path']}?mode=ro", uri=True) as c:
        return c.execute("SELECT 1 FROM sqlite_master WHERE name = ?", [table]).fetchone() is not None


def write_sqlite(df: DataFrame, options: dict, table: str, keys: list[str] | None = None, overwrite: bool = False) -> None:
    """Types that SQLite lacks go as text, whole numbers as 64 bits."""

    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, (T.FractionalType,)) and not isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        return c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else c.cast("string").alias(f.name)

    _registered(df.sparkSession)
    writer = df.select(*[plain(f) for f in df.schema]).write.format("weftline_sqlite").option("path", options["path"]).option("table", table)
    writer.option("keys", ",".join(keys or [])).mode("overwrite" if overwrite else "append").save()
