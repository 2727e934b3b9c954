"""Shapes, sinks, sources, streams and the as-of join."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from weftline.operators.asof import asof_join
from weftline.operators.shape import h2v, h4v, uniqkv, v2h, v4h
from weftline.plans.job import Job
from weftline.sinks import apply_mode
from weftline.sources import Catalog, register_driver
from weftline.streaming import StateTable, run_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_wide_and_long(spark):
    wide = spark.createDataFrame([(1, 10, 20), (2, 30, None)], "id long, x long, y long")
    assert rows(v4h(wide, "k", "v", ["id"])) == [(1, "x", 10), (1, "y", 20), (2, "x", 30), (2, "y", None)]
    long = h2v(wide, "id", "k", "v")
    assert rows(v2h(long, "k", "id", "v")) == [(1, 10, 20), (2, 30, 0)]
    assert rows(h4v(long, "k", "v", "id")) == [(1, 10, 20), (2, 30, None)]
    assert rows(v2h(long, "k", "id")) == [(1, 1, 1), (2, 1, 1)]
    first = spark.createDataFrame([(1, "a", "p", 5), (1, "b", "q", 6), (2, "c", "p", 7)], "id long, name string, k string, v long")
    assert rows(uniqkv(first, "id", "k", "v", order="name")) == [(1, "a", 5, 6), (2, "c", 7, 0)]


def test_repeated_keys_lose_no_row(spark):
    long = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "b", 4)], "id long, k string, v long").coalesce(1)
    assert rows(h4v(long, "k", "v", "id")) == [(1, 1, 2), (1, 3, 4)]


def test_wide_by_null_and_many_keys(spark):
    """Values under a null key are kept, as the key None; more keys than a pivot may have are refused, none is left out."""
    long = spark.createDataFrame([(1, "a", "p", 5), (1, "b", None, 6), (1, "c", None, 1), (2, "d", "None", 7), (2, "e", "q", 2)], "id long, name string, k string, v long")
    got = uniqkv(long, "id", "k", "v", order="name")
    assert sorted(got.columns) == ["None", "id", "name", "p", "q"]
    assert rows(got.select("id", "name", "None", "p", "q")) == [(1, "a", 7, 5, 0), (2, "d", 7, 0, 2)]
    texts = uniqkv(long.withColumn("v", F.col("name")), "id", "k", "v", order="name")
    assert rows(texts.select("id", "None")) == [(1, "c"), (2, "d")]
    spark.conf.set("spark.sql.pivotMaxValues", 3)
    try:
        with pytest.raises(ValueError, match="more than 3 keys"):
            uniqkv(long, "id", "k", "v")
        assert uniqkv(long.where("k <> 'q'"), "id", "k", "v").count() == 2
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


OLD = [(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, "d", 2)]
NEW = [(2, "B", 9), (3, "c", 9), (5, "e", 1)]


@pytest.mark.parametrize(
    ("mode", "expected"),
    [
        ("insert", sorted([*OLD, *NEW], key=str)),
        ("update", [(1, "a", 1), (2, "B", 9), (3, "c", 1), (4, "d", 2)]),
        ("upsert", [(1, "a", 1), (2, "B", 9), (3, "c", 1), (4, "d", 2), (5, "e", 1)]),
        ("sync", [(2, "B", 9), (3, "c", 1), (4, "d", 2), (5, "e", 1)]),
        ("replace", [(2, "B", 9), (3, "c", 9), (4, "d", 2), (5, "e", 1)]),
    ],
)
def test_modes(spark, mode, expected):
    """The third column is neutral: alone it makes no update.  Rows with 1 there are the job's own."""
    old, new = (spark.createDataFrame(x, "id long, v string, t long") for x in (OLD, NEW))
    after = apply_mode(mode, old, new, ["id"], ["t"], lambda df: df["t"] == 1).drop("_change")
    assert rows(after) == expected


def test_sync_twice_changes_nothing(spark, tmp_path):
    catalog = Catalog(spark, [{"name": "f", "driver": "parquet", "path": str(tmp_path)}])
    catalog.put("m.in", spark.createDataFrame(OLD, "id long, v string, t long"))
    config = {"input": "&.m.in", "output": "&.f.out::id use UDI", "schema": {"id": "$.id", "v": "$.v"}}
    assert Job.from_config(spark, config, catalog=catalog).run()["inserted"] == 4
    again = Job.from_config(spark, config, catalog=catalog).run()
    assert (again["inserted"], again["updated"]) == (0, 0)
    catalog.put("m.in", spark.createDataFrame(NEW, "id long, v string, t long"))
    assert Job.from_config(spark, config, catalog=catalog).run()["updated"] == 1
    assert rows(catalog.read("f.out")) == [(2, "B"), (3, "c"), (5, "e")]


def test_file_drivers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "n": {"x": [5, 6]}}, {"id": 2}]')
    (tmp_path / "b.csv").write_text('id,name\n1,"x, y"\n2,\n')
    (tmp_path / "log").write_text('1.2.3.4 - "GET /a b" [now] 200\n')
    c = Catalog(spark, [{"name": "j", "driver": "json", "path": str(tmp_path)}, {"name": "c", "driver": "csv", "path": str(tmp_path)}, {"name": "l", "driver": "textline", "path": str(tmp_path), "format": "line", "sep": " ", "segments": 5}])
    job = Job.from_config(spark, {"input": "&.j.a", "schema": {"id": "$.id", "x": "$.n.x.:1"}}, catalog=c)
    assert rows(job.plan()) == [(1, 6), (2, None)]
    assert rows(c.read("c.b")) == [("1", "x, y"), ("2", None)]
    assert c.read("l.log").first()["seg2"] == "GET /a b"
    assert c.read("g.--3").count() == 3


def test_sqlite_and_custom_drivers(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(10)])
    register_driver("ten", lambda s, options, table: s.range(10))
    c = Catalog(spark, [{"name": "s", "driver": "sqlite", "path": path}, {"name": "u", "driver": "ten"}])
    assert c.read("s.t").where("id >= 7").count() == 3
    assert c.read("u.any").count() == 10


def test_asof(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id long, k string, t long")
    right = spark.createDataFrame([("u", 1, 10), ("u", 4, 40), ("u", 5, 50)], "k string, t long, v long")
    assert rows(asof_join(left, right, ["k"], "t", "t", ["v"])) == [(1, "u", 5, 40), (2, "u", 1, None), (3, "v", 9, None)]
    assert rows(asof_join(left, right, ["k"], "t", "t", ["v"], strict=False))[0] == (1, "u", 5, 50)


def test_asof_ties_go_to_the_largest(spark):
    left = spark.createDataFrame([(1, "u", 5)], "id long, k string, t long")
    right = spark.createDataFrame([("u", 4, 1, 70), ("u", 4, 3, 60), ("u", 4, 2, 80)], "k string, t long, n long, v long")
    assert rows(asof_join(left, right, ["k"], "t", "t", ["v"], ties=["n"])) == [(1, "u", 5, 60)]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    first.write.parquet(str(source))
    catalog = Catalog(spark, [{"name": "f", "driver": "parquet", "path": str(out)}])
    config = {"input": "&.f.unused", "output": "&.f.t::id use UI", "schema": {"id": "$.id", "v": "$.v"}}
    state = StateTable(spark, str(tmp_path / "state"))

    def go():
        stream = spark.readStream.schema(first.schema).parquet(str(source))
        run_stream(Job.from_config(spark, config, catalog=catalog), stream, str(tmp_path / "check"), state=state).awaitTermination()

    go()
    spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string").write.mode("append").parquet(str(source))
    go()
    assert rows(catalog.read("f.t")) == [(1, "a"), (2, "B"), (3, "c")]
    assert state.get()["batch"] == "1"


def test_filters_and_columns_reach_the_scan(spark):
    from weftline.queries import QUERIES

    plan = QUERIES["filter_ops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" in plan and "GreaterThanOrEqual(o_totalprice,1000.0)" in plan and "o_custkey" not in plan
    assert F is not None


def test_textline_names_every_segment_and_console_tells_the_rest(spark, tmp_path, capsys):
    (tmp_path / "wide").write_text("a b\n" + " ".join(f"x{i}" for i in range(20)) + "\n")
    catalog = Catalog(spark, [{"name": "t", "driver": "textline", "path": str(tmp_path), "sep": " "}, {"name": "c", "driver": "console", "rows": 2}])
    got = catalog.read("t.wide")
    assert got.columns == [*[f"seg{i}" for i in range(20)], "line"]
    assert sorted(str(r["seg19"]) for r in got.collect()) == ["None", "x19"]
    from weftline.sinks import stores

    stores.write(catalog, "c.out", spark.range(5), "insert", [], [], lambda df: F.lit(True))
    assert "3 more rows are not shown" in capsys.readouterr().out
