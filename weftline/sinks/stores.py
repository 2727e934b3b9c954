"""Writing a job's rows to its output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sinks.modes import apply_mode
from weftline.sources import sqlite
from weftline.sources.drivers import JDBC, _path

FORMATS = {"parquet": ".parquet", "json": ".json", "csv": ".csv", "textline": ""}


#: Sinks by driver name: functions of (rows, options, table, mode, keys).
SINKS: dict[str, Callable[[DataFrame, dict, str, str, list[str]], dict[str, Any] | None]] = {}


def register_sink(driver: str, put: Callable[[DataFrame, dict, str, str, list[str]], dict[str, Any] | None]) -> None:
    """Where rows of a driver's databases go: a function of (rows, options of the database, table, mode, keys); what it gives joins the status."""
    SINKS[driver] = put


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    return df.select(*[F.to_json(n).alias(n) if isinstance(df.schema[n].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{n}`") for n in df.columns])


def _save(df: DataFrame, driver: str, path: str, options: dict, mode: str) -> None:
    if driver == "textline":
        kind = options.get("format", "json")
        if kind == "txt":
            df.select(F.concat_ws(options.get("sep", " "), *[F.col(f"`{n}`").cast("string") for n in df.columns]).alias("value")).write.mode(mode).text(path)
            return
        driver = kind
    writer = (_flat(df) if driver == "csv" else df).write.mode(mode)
    if driver == "csv":
        writer.option("header", True).option("quoteAll", bool(options.get("quote_all", False))).option("sep", options.get("delimiter", ",")).csv(path)
    else:
        writer.format(driver).save(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes its path objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):  # a file system tells a failure by false
        raise OSError(f"{source} could not be renamed to {target}")


def _swap(spark: SparkSession, df: DataFrame, driver: str, path: str, options: dict) -> None:
    """The new table is written whole beside the old one and takes its place by renaming; a failure leaves the old one, or puts it back."""
    staged, old = (f"{path.rstrip('/')}.{x}-{uuid.uuid4().hex[:8]}" for x in ("new", "old"))
    _save(df, driver, staged, options, "error")
    fs, at = _files(spark, path)
    had = fs.exists(at(path))
    if had:
        _moved(fs, at(path), at(old))
    try:
        _moved(fs, at(staged), at(path))
    except BaseException:
        if had:
            _moved(fs, at(old), at(path))
        raise
    if had:
        fs.delete(at(old), True)


def _append_once(spark: SparkSession, df: DataFrame, driver: str, path: str, options: dict, batch: str, note: Callable[[], Any], empty: bool) -> tuple[bool, Any]:
    """Appends the rows of a named batch, unless its mark tells that it has been; gives whether, and what was noted with it.

    The batch is written beside the table; its files, named after it, are moved in; then the mark is made,
    with a note.  A run that was stopped in between leaves files of that name, which go before the batch is written again.
    Where ``empty`` batches may fill later, one without a note gets no mark.
    """
    fs, at = _files(spark, path)
    folder, mark = at(path), at(f"{path}/_batches/{batch}")
    if fs.exists(mark):
        return False, json.loads(spark.read.text(mark.toString()).first()[0])
    begun = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith(f"{batch}-")] if fs.exists(folder) else []
    for file in begun:
        fs.delete(file, False)
    staged = at(f"{path}/_staged-{batch}")
    fs.delete(staged, True)
    _save(df, driver, staged.toString(), options, "error")
    for file in [f.getPath() for f in fs.listStatus(staged)]:
        if not file.getName().startswith(("_", ".")):
            _moved(fs, file, at(f"{path}/{batch}-{file.getName()}"))
    noted = note()
    if noted is not None or not empty:
        out = fs.create(at(f"{path}/_batches/.{batch}"), True)
        out.write(bytearray(json.dumps(noted).encode()))
        out.close()
        _moved(fs, at(f"{path}/_batches/.{batch}"), mark)
    fs.delete(staged, True)
    return True, noted


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write(catalog, name: str, df: DataFrame, mode: str, keys: list[str], neutral: list[str], scope: Callable[[DataFrame], Column], batch: str | None = None, note: Callable[[], Any] = lambda: None, empty: bool = False) -> dict[str, Any]:
    """Write and tell how many rows were inserted and updated, where the sink can tell.

    ``note`` is asked after the rows are written; what it gives comes back as ``note``.
    A named ``batch`` is appended to files no more than once.
    """
    spark = catalog.spark
    driver = catalog.databases.get(name.partition(".")[0], {}).get("driver")
    if batch is not None and mode == "insert" and driver in FORMATS:
        options = catalog.databases[name.partition(".")[0]]
        done, noted = _append_once(spark, df, driver, _path(options, name.partition(".")[2], FORMATS[driver]), options, batch, note, empty)
        return {"mode": mode, "note": noted} | ({} if done else {"repeated": 1})
    status = _write(catalog, name, df, mode, keys, neutral, scope)
    return status | {"note": note()}


def _write_sqlite(catalog, name: str, df: DataFrame, mode: str, keys: list[str], neutral: list[str], scope: Callable[[DataFrame], Column]) -> dict[str, Any]:
    """Only rows that change go to the database, in one transaction; a replacement goes whole."""
    db, _, table = name.partition(".")
    options = catalog.databases[db]
    if mode == "insert" or not sqlite.exists(options, table):
        if mode != "update":
            sqlite.write_sqlite(df, options, table)
        return {"mode": mode}
    target = catalog.read(name)
    after = apply_mode(mode, target, df, keys, neutral, scope)
    if mode == "replace":
        sqlite.write_sqlite(after.drop("_change"), options, table, overwrite=True)
        return {"mode": mode}
    seen = Observation(f"write{uuid.uuid4().hex[:6]}")
    changed = after.observe(seen, F.count_if(F.col("_change") == "insert").alias("inserted"), F.count_if(F.col("_change") == "update").alias("updated")).where("_change <> 'same'")
    rows = changed.withColumn("_op", F.when(F.col("_change") == "update", "put")).drop("_change")
    if mode == "sync":
        left = after.select(*keys)
        same = [target[k].cast(left.schema[k].dataType).eqNullSafe(left[k]) for k in keys]
        gone = target.join(left, reduce(and_, same), "left_anti")
        rows = rows.unionByName(gone.select(*keys, F.lit("delete").alias("_op")), allowMissingColumns=True)
    sqlite.write_sqlite(rows, options, table, keys)
    return {"mode": mode} | dict(seen.get)


def _write(catalog, name: str, df: DataFrame, mode: str, keys: list[str], neutral: list[str], scope: Callable[[DataFrame], Column]) -> dict[str, Any]:
    spark = catalog.spark
    db, _, table = name.partition(".")
    if table.startswith("--"):  # a sink that keeps nothing
        df.write.format("noop").mode("overwrite").save()
        return {"mode": mode}
    options = catalog.databases.get(db, {"driver": "console" if db == "stdio" or table.startswith("&") else "memory"})
    driver = options.get("driver", "memory")
    if table in ("&1", "&2") or driver in ("console", "stdio"):
        most = int(options.get("rows", 1000))
        df.show(most, truncate=False)
        if (left := df.count() - most) > 0:
            print(f"{left} more rows are not shown")
        return {"mode": mode}
    if driver in SINKS:
        return {"mode": mode} | (SINKS[driver](df, options, table, mode, keys) or {})
    if driver == "memory":
        before = catalog.memory.get(name)
        after = df.withColumn("_change", F.lit("insert")) if before is None else apply_mode(mode, before, df, keys, neutral, scope)
        catalog.memory[name] = after.drop("_change")
        return {"mode": mode}
    if driver in FORMATS:
        path = _path(options, table, FORMATS[driver])
        if mode == "insert":
            _save(df, driver, path, options, "append")
            return {"mode": mode}
        if not _exists(spark, path):
            after = df.withColumn("_change", F.lit("insert")) if mode != "update" else df.limit(0).withColumn("_change", F.lit("same"))
        else:
            target = catalog.read(name)
            after = apply_mode(mode, target, df, keys, neutral, scope)
        seen = Observation(f"write{uuid.uuid4().hex[:6]}")
        counted = after.observe(seen, F.count_if(F.col("_change") == "insert").alias("inserted"), F.count_if(F.col("_change") == "update").alias("updated"))
        _swap(spark, counted.drop("_change"), driver, path, options)
        return {"mode": mode} | dict(seen.get)
    if driver == "sqlite":
        return _write_sqlite(catalog, name, df, mode, keys, neutral, scope)
    if driver in JDBC:
        url_name, driver_class = JDBC[driver]
        url = options.get("url") or f"jdbc:{url_name}://{options['host']}:{options.get('port', '')}/{options.get('db', '')}"
        properties = {"driver": options.get("driver_class", driver_class)} | {k: options[k] for k in ("user", "password") if k in options}
        if mode == "insert":
            df.write.jdbc(url, table, "append", properties)
        else:
            after = apply_mode(mode, catalog.read(name), df, keys, neutral, scope).drop("_change")
            after.write.option("truncate", True).jdbc(url, f"{table}_weftline_new", "overwrite", properties)
            spark.read.jdbc(url, f"{table}_weftline_new", properties=properties).write.option("truncate", True).jdbc(url, table, "overwrite", properties)
        return {"mode": mode}
    if mode != "insert":
        raise ValueError(f"{driver} takes inserts only")
    df.write.format(options.get("format", driver)).options(**options.get("options", {})).mode("append").save()
    return {"mode": mode}
