"""Databases by name, their drivers, and views over them."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.sources import drivers

DRIVERS: dict[str, Callable[[SparkSession, dict, str], DataFrame]] = dict(drivers.READERS)


def register_driver(name: str, read: Callable[[SparkSession, dict, str], DataFrame]) -> None:
    """A driver is a function of (spark, options, table) that gives a DataFrame."""
    DRIVERS[name] = read


class Catalog:
    """The databases of a job.  A table is ``database.table``; ``x.--N`` is N empty rows of any database x."""

    def __init__(self, spark: SparkSession, databases: list[dict] | None = None):
        self.spark = spark
        self.databases: dict[str, dict] = {}
        self.memory: dict[str, DataFrame] = {}
        self.functions: dict[str, Callable] = {}
        self.lookups: dict[str, Callable[[DataFrame], DataFrame]] = {}
        for d in databases or []:
            self.add(d)

    def add(self, database: dict) -> None:
        self.databases[database["name"]] = database

    def put(self, name: str, df: DataFrame) -> None:
        """A table in memory, under its whole name."""
        self.memory[name] = df

    def register_function(self, name: str, fn: Callable) -> None:
        """A table-valued function of (spark, filters), read as ``&.=@name``; one of three arguments gets the whole request: fields, filters, orders and cursor."""
        self.functions[name] = fn

    def register_lookup(self, name: str, fn: Callable[[list[dict]], Iterable[dict]], schema: str, batch: int = 10_000) -> None:
        """A function from keys to rows, looked up as ``&.=@name::key``.

        It runs in the tasks; each different key of a job's rows is asked for once, at most ``batch`` at a time.
        Rows it gives have the columns of ``schema``, the keys among them.
        """

        def ask(keys: DataFrame) -> DataFrame:
            names = keys.columns

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for found in batches:
                    for at in range(0, found.num_rows, batch):
                        part = found.slice(at, batch)
                        rows = [{n: r.get(n) for n in kinds.names} for r in fn(pa.RecordBatch.from_arrays(part.columns, names=names).to_pylist())]
                        yield pa.RecordBatch.from_pylist(rows, kinds)

            out = self.spark.createDataFrame([], schema).schema
            kinds = to_arrow_schema(out)
            return keys.mapInArrow(run, out)

        self.lookups[name] = ask

    def call(self, name: str, request: dict) -> DataFrame:
        """What a registered function gives for a request."""
        fn = self.function(name)
        whole = sum(p.default is p.empty for p in inspect.signature(fn).parameters.values()) > 2
        return fn(self.spark, request["filters"], request) if whole else fn(self.spark, request["filters"])

    def function(self, name: str) -> Callable:
        return self.functions[name]

    def split(self, name: str) -> tuple[dict, str]:
        db, _, table = name.partition(".")
        if db not in self.databases:
            raise ValueError(f"unknown database {db!r}")
        return self.databases[db], table

    def read(self, name: str) -> DataFrame:
        return self.read_filtered(name, {})[0]

    def read_filtered(self, name: str, tests: dict) -> tuple[DataFrame, dict]:
        """The table, and those of the tests that it has not taken as a view's arguments."""
        if name in self.memory:
            return self.memory[name], tests
        if (m := re.search(r"\.--(\d*)$", name)) is not None:
            return self.spark.range(int(m[1] or 1)).select(), tests
        if name.startswith("=@"):
            return self.call(name[2:], {"fields": [], "filters": tests, "orders": [], "cursor": None}), {}
        database, table = self.split(name)
        for view in database.get("virtual_views", []):
            found = view.get("name") == table or ("name_match" in view and re.fullmatch(view["name_match"], table))
            if found:
                return self._view(database, view, table, tests)
        driver = database.get("driver", "memory")
        if driver == "memory":
            raise ValueError(f"no table {name!r} in memory")
        if driver not in DRIVERS:
            raise ValueError(f"unknown driver {driver!r}")
        return DRIVERS[driver](self.spark, database, table), tests

    def stream(self, name: str, files: int | None = None) -> DataFrame:
        """A table of Parquet, CSV or JSON lines as a stream of its files, or a queue of its jobs, at most so many a batch."""
        database, table = self.split(name)
        driver = database.get("driver", "memory")
        if driver == "beanstalk":
            return drivers.stream_queue(self.spark, database | ({"batch": files} if files else {}), table)
        if driver not in drivers.STREAMED or driver == "json" and not database.get("lines"):
            raise ValueError(f"{name!r} cannot be read as a stream; files of Parquet, CSV or JSON lines can")
        path = drivers._path(database, table, drivers.STREAMED[driver])
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
            path = f"{path[:-1]}[{path[-1]}]"  # a stream reads folders and patterns: the pattern of this one file
        reader = self.spark.readStream.schema(self.read(name).schema).format(driver)
        reader = reader.option("maxFilesPerTrigger", files) if files else reader
        return (reader.option("header", True).option("sep", database.get("delimiter", ",")) if driver == "csv" else reader).load(path)

    def _view(self, database: dict, view: dict, table: str, tests: dict) -> tuple[DataFrame, dict]:
        """A query's text; its arguments take the tests of their column and operator, or their default, in order."""
        rest = {k: dict(t) for k, t in tests.items()}
        bound = []
        for column, op, *default in view.get("args", []):
            key = next((k for k in rest if k.partition("|")[0] == column and op in rest[k]), None)
            bound.append(rest[key].pop(op) if key is not None else default[0] if default else None)
        rest = {k: t for k, t in rest.items() if t}
        query = view["query"].replace("{table}", table)
        driver = database.get("driver", "sql")
        if driver in drivers.JDBC:
            head, *rests = query.split("?", len(bound))  # a bound text may hold a ? of its own
            query = head + "".join(_quoted(v) + r for v, r in zip(bound, rests, strict=True))
            return drivers.read_query(self.spark, database, query), rest
        for name in view.get("tables", []):
            DRIVERS[driver](self.spark, database, name).createOrReplaceTempView(name)
        return (self.spark.sql(query, args=bound) if bound else self.spark.sql(query)), rest


def _quoted(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
