"""Pages over cursors that tie, and batches that are repeated after a run was stopped."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.__main__ import run
from weftline.plans.job import Job
from weftline.sinks import stores

ROWS = [(1, "a"), (2, "b"), (2, "c"), (2, "d"), (None, "n"), (None, "m"), (3, "d"), (3, None), (4, "e")]


class Stop(Exception):
    pass


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def document(spark, tmp_path, table=ROWS, **more):
    spark.createDataFrame(table, "k long, v string").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "rows.parquet"))
    config = {"databases": [{"name": "f", "driver": "parquet", "path": str(tmp_path)}], "input": "&.f.rows", "output": "&.f.out::k+v use I", "schema": {"k": "$.k", "v": "$.v"}, "cursor": "k", "orders": ["$.k"], "states": ["&.f.job"]} | more
    path = tmp_path / "job.json"
    path.write_text(json.dumps(config))
    return str(path)


def written(spark, tmp_path):
    return rows(spark.read.parquet(str(tmp_path / "out.parquet")))


@pytest.mark.parametrize("falls", [False, True])
def test_tied_rows_come_once(spark, tmp_path, falls):
    path = document(spark, tmp_path, orders=[["$.k", falls]])
    seen = []
    for _ in range(6):
        run(spark, path, {"@limit": 2, "@recovery": True})
        seen.append(len(written(spark, tmp_path)))
    assert seen == [2, 4, 6, 8, 9, 9]
    assert written(spark, tmp_path) == sorted(ROWS, key=str)


def test_rows_that_arrive_behind_the_last_page(spark, tmp_path):
    path = document(spark, tmp_path, cursor=["k", "v"], table=[(1, "a"), (1, "b")])
    for _ in range(3):
        run(spark, path, {"@limit": 5, "@recovery": True})
    spark.createDataFrame([(1, "c"), (2, "a")], "k long, v string").write.mode("append").parquet(str(tmp_path / "rows.parquet"))
    run(spark, path, {"@limit": 5, "@recovery": True})
    assert written(spark, tmp_path) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]


def test_a_run_that_stops_between_rows_and_state(spark, tmp_path, monkeypatch):
    path = document(spark, tmp_path)
    run(spark, path, {"@limit": 2, "@recovery": True})
    with monkeypatch.context() as m:
        m.setattr(Job, "_keep_states", lambda *a: (_ for _ in ()).throw(Stop()))
        with pytest.raises(Stop):
            run(spark, path, {"@limit": 2, "@recovery": True})
    assert len(written(spark, tmp_path)) == 4
    for _ in range(5):
        run(spark, path, {"@limit": 2, "@recovery": True})
    assert written(spark, tmp_path) == sorted(ROWS, key=str)


def test_a_run_that_stops_before_its_mark(spark, tmp_path, monkeypatch):
    path = document(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(stores.json, "dumps", lambda *a: (_ for _ in ()).throw(Stop()))
        with pytest.raises((Stop, TypeError)):
            stores.write(Job.from_config(spark, path).catalog, "f.out", spark.range(3).select(F.col("id").alias("k")), "insert", [], [], None, batch="one")
    assert len(written(spark, tmp_path)) == 3
    catalog = Job.from_config(spark, path).catalog
    for n in (5, 7):  # the second comes too late
        stores.write(catalog, "f.out", spark.range(n).select(F.col("id").alias("k")), "insert", [], [], None, batch="one")
    assert len(written(spark, tmp_path)) == 5


def test_a_repeated_micro_batch_doubles_no_row(spark, tmp_path):
    path = document(spark, tmp_path, cursor=None, states=[])
    given = {"@streaming": True, "@recovery": str(tmp_path / "place")}
    run(spark, path, given)
    for folder in ("commits", "sources"):  # as if the run had ended after the rows, before the stream's own record
        for f in (tmp_path / "place" / folder).rglob("*"):
            if f.is_file() and folder == "commits":
                f.unlink()
    (status,) = run(spark, path, given)
    assert status["repeated"] == 1
    assert written(spark, tmp_path) == sorted(ROWS, key=str)


def test_a_failed_rename_leaves_the_table(spark, tmp_path, monkeypatch):
    path = document(spark, tmp_path, output="&.f.out::k use UDI", cursor=None, states=[], table=ROWS[:3])
    run(spark, path, {})
    before = written(spark, tmp_path)
    moved, calls = stores._moved, []

    def second_fails(fs, source, target):
        calls.append(source)
        if len(calls) == 2:
            raise OSError("no")
        moved(fs, source, target)

    monkeypatch.setattr(stores, "_moved", second_fails)
    document(spark, tmp_path, output="&.f.out::k use UDI", cursor=None, states=[])
    with pytest.raises(OSError):
        run(spark, path, {})
    assert written(spark, tmp_path) == before
