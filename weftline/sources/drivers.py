"""Drivers: files, text lines, Excel, SQL databases, HTTP, key-value stores and queues.

File sources are Spark's own readers, so filters and columns reach the files.
Drivers that need a connector or a library which is not there say so when used.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weftline.sources.queue import QueueSource
from weftline.sources.sqlite import read_sqlite

# JDBC's name and class of each SQL database.
JDBC = {
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "postgresql": ("postgresql", "org.postgresql.Driver"),
    "sqlserver": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("oracle:thin", "oracle.jdbc.OracleDriver"),
    "clickhouse": ("clickhouse", "com.clickhouse.jdbc.ClickHouseDriver"),
    "jdbc": ("", ""),
}


STREAMED = {"parquet": ".parquet", "csv": ".csv", "json": ".json"}


def _path(options: dict, table: str, ending: str) -> str:
    path = f"{options.get('path', '.').rstrip('/')}/{table}"
    return path if not ending or table.endswith(ending) or "://" not in path and os.path.exists(path) else path + ending


def read_parquet(spark: SparkSession, options: dict, table: str) -> DataFrame:
    return spark.read.parquet(_path(options, table, ".parquet"))


def read_json(spark: SparkSession, options: dict, table: str) -> DataFrame:
    """A JSON array or one object a line; field order is the file's."""
    lines = options.get("lines", False)
    return spark.read.option("multiLine", not lines).json(_path(options, table, ".json"), schema=options.get("schemas", {}).get(table))


def read_csv(spark: SparkSession, options: dict, table: str) -> DataFrame:
    """All columns are text, as the header names them."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    names = {"delimiter": "sep", "quotechar": "quote", "escapechar": "escape", "encoding": "encoding"}
    for ours, theirs in names.items():
        if ours in options:
            reader = reader.option(theirs, options[ours])
    return reader.csv(_path(options, table, ".csv"))


def read_textline(spark: SparkSession, options: dict, table: str) -> DataFrame:
    """Lines: whole (``line``), parted by ``sep`` outside quotes and brackets (``seg0``...), as csv or as json."""
    path, kind = _path(options, table, ""), options.get("format", "csv" if options.get("header") else "line")
    if kind == "json":
        return spark.read.json(path)
    if kind == "csv":
        return read_csv(spark, options, table)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    if "sep" not in options:
        return lines
    from weftline.functions import call
    from weftline.lang.values import Value, literal

    parts = call("textline::split", [Value(F.col("line"), lines.schema["line"].dataType), literal(options["sep"])]).col
    # at least 16 columns; more if a line has more segments, which takes a pass over the file
    most = int(options["segments"]) if "segments" in options else max(16, lines.agg(F.max(F.size(parts))).first()[0] or 0)
    return lines.select(*[F.get(parts, i).alias(f"seg{i}") for i in range(most)], "line")


def _jdbc(spark: SparkSession, options: dict):
    name, driver = JDBC[options.get("driver", "jdbc")]
    url = options.get("url") or f"jdbc:{name}://{options['host']}:{options.get('port', '')}/{options.get('db', '')}"
    reader = spark.read.format("jdbc").option("url", url).option("driver", options.get("driver_class", driver))
    for key in ("user", "password", "fetchsize", "partitionColumn", "lowerBound", "upperBound", "numPartitions"):
        if key in options:
            reader = reader.option(key, options[key])
    return reader


def read_jdbc(spark: SparkSession, options: dict, table: str) -> DataFrame:
    return _jdbc(spark, options).option("dbtable", table).load()


def read_query(spark: SparkSession, options: dict, query: str) -> DataFrame:
    return _jdbc(spark, options).option("query", query).load()


class _Part(InputPartition):
    def __init__(self, at: Any):
        self.at = at


class HttpSource(DataSource):
    """Rows of JSON from a web address, one request a page."""

    @classmethod
    def name(cls) -> str:
        return "weftline_http"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [_Part(i) for i in range(int(options.get("pages", 1)))]

            def read(self, partition: _Part) -> Iterator[tuple]:
                from urllib.request import urlopen

                with urlopen(options["url"].replace("{page}", str(partition.at)), timeout=float(options.get("timeout", 30))) as r:  # noqa: S310
                    rows = json.load(r)
                for key in filter(None, options.get("return", "").split(".")):
                    rows = rows[key]
                for row in rows:
                    yield tuple(row.get(n) for n in schema.names)

        return Reader()


def read_http(spark: SparkSession, options: dict, table: str) -> DataFrame:
    spark.dataSource.register(HttpSource)
    reader = spark.read.format("weftline_http").option("url", f"{options['url'].rstrip('/')}/{table}").option("columns", options["columns"])
    for key in ("pages", "return", "timeout"):
        if key in options:
            reader = reader.option(key, options[key])
    return reader.load()


def read_excel(spark: SparkSession, options: dict, table: str) -> DataFrame:
    """``file.xlsx#sheet`` with a header row; a workbook is read whole on the driver, and is limited by its format to a million rows."""
    import pandas as pd

    file, _, sheet = table.partition("#")
    return spark.createDataFrame(pd.read_excel(_path(options, file, ".xlsx"), sheet_name=sheet or 0))


class RedisSource(DataSource):
    """Keys of a prefix, lists (``list#``) or hashes (``hash#``), values as JSON or text; nothing is ever unpickled."""

    @classmethod
    def name(cls) -> str:
        return "weftline_redis"

    def schema(self) -> str:
        return self.options.get("columns", "key string, value string")

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)

        class Reader(DataSourceReader):
            def read(self, partition) -> Iterator[tuple]:
                import redis

                client = redis.Redis(host=options.get("host", "localhost"), port=int(options.get("port", 6379)), decode_responses=True)
                kind, _, name = options["table"].rpartition("#")
                if kind == "list":
                    found = enumerate(client.lrange(name, 0, -1))
                elif kind == "hash":
                    found = client.hscan_iter(name)
                else:
                    found = ((k, client.get(k)) for k in client.scan_iter(f"{name}*"))
                for key, value in found:
                    if schema.names == ["key", "value"]:
                        yield str(key), value
                    else:
                        row = json.loads(value) | {"key": str(key)}
                        yield tuple(row.get(n) for n in schema.names)

        return Reader()


def read_redis(spark: SparkSession, options: dict, table: str) -> DataFrame:
    spark.dataSource.register(RedisSource)
    reader = spark.read.format("weftline_redis").option("table", table)
    for key in ("host", "port", "columns"):
        if key in options:
            reader = reader.option(key, options[key])
    return reader.load()


def _connector(fmt: str, name: Callable[[dict, str], dict]) -> Callable[[SparkSession, dict, str], DataFrame]:
    """A public Spark connector that the cluster brings along."""

    def read(spark: SparkSession, options: dict, table: str) -> DataFrame:
        reader = spark.read.format(fmt)
        for k, v in (name(options, table) | options.get("options", {})).items():
            reader = reader.option(k, v)
        return reader.load()

    return read


def read_queue(spark: SparkSession, options: dict, table: str) -> DataFrame:
    raise ValueError(f"the queue {table!r} is read as a stream: name it with `use P`, or run with @streaming")


def stream_queue(spark: SparkSession, options: dict, table: str) -> DataFrame:
    spark.dataSource.register(QueueSource)
    reader = spark.readStream.format("weftline_queue").option("tube", table)
    for key in ("host", "port", "columns", "batch"):
        if key in options:
            reader = reader.option(key, options[key])
    return reader.load()


READERS: dict[str, Callable[[SparkSession, dict, str], DataFrame]] = {
    "parquet": read_parquet,
    "json": read_json,
    "csv": read_csv,
    "textline": read_textline,
    "execl": read_excel,
    "excel": read_excel,
    **{name: read_jdbc for name in JDBC},
    "sqlite": read_sqlite,
    "http": read_http,
    "redis": read_redis,
    "mongo": _connector("mongodb", lambda o, t: {"connection.uri": o.get("url", "mongodb://localhost"), "database": o.get("db", ""), "collection": t} | ({"aggregation.pipeline": json.dumps(o["pipeline"])} if "pipeline" in o else {})),
    "elasticsearch": _connector("org.elasticsearch.spark.sql", lambda o, t: {"es.nodes": o.get("host", "localhost"), "es.resource": t}),
    "influxdb": _connector("influxdb", lambda o, t: {"url": o.get("url", ""), "bucket": o.get("db", ""), "measurement": t}),
    "kafka": _connector("kafka", lambda o, t: {"kafka.bootstrap.servers": o.get("host", ""), "subscribe": t}),
    "beanstalk": read_queue,
    "sql": lambda spark, options, table: spark.table(table),
}
