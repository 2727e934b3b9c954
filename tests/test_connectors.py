"""A queue against a small server, SQLite with filters and transactions, functions as tables."""

import json
import os
import resource
import socketserver
import sqlite3
import threading
from contextlib import closing, nullcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.job import Job
from weftline.sinks import write
from weftline.sources import Catalog
from weftline.sources import sqlite as stores
from weftline.sources.sqlite import SqliteWriter, Staged, write_sqlite
from weftline.streaming import run_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class Tube(socketserver.BaseRequestHandler):
    """Enough of the protocol for one tube; what a closed connection has reserved is ready again."""

    def handle(self):
        mine, lines = {}, self.request.makefile("rb")
        for line in lines:
            word, *args = line.decode().split()
            if word in ("watch", "ignore"):
                answer = b"WATCHING 1"
            elif word == "reserve-with-timeout":
                ready = self.server.ready
                if ready:
                    i = min(ready)
                    mine[i] = ready.pop(i)
                    answer = b"RESERVED %d %d\r\n%s" % (i, len(mine[i]), mine[i])
                else:
                    answer = b"TIMED_OUT"
            elif word == "delete":
                found = mine.pop(int(args[0]), None) is not None or self.server.ready.pop(int(args[0]), None) is not None
                self.server.deleted += [int(args[0])] * found
                answer = b"DELETED" if found else b"NOT_FOUND"
            self.request.sendall(answer + b"\r\n")
        self.server.ready.update(mine)


@pytest.fixture
def tube():
    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Tube)
    server.daemon_threads, server.ready, server.deleted = True, {}, []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def queue_job(spark, tmp_path, tube):
    databases = [{"name": "q", "driver": "beanstalk", "host": "127.0.0.1", "port": tube.server_address[1], "columns": "k bigint, v string", "batch": 4}, {"name": "f", "driver": "parquet", "path": str(tmp_path)}]
    job = Job.from_config(spark, {"databases": databases, "input": "&.q.jobs use P", "output": "&.f.out::k use I", "schema": {"k": "$.k", "v": "$.v"}})
    return run_stream(job, job.catalog.stream("q.jobs"), str(tmp_path / "place"), period="1 second")


def until(query, done, most=60):
    for _ in range(most):
        if done() or query.exception() is not None:
            break
        query.processAllAvailable()
    query.stop()
    assert query.exception() is None


def test_a_queue_goes_through_a_job_once(spark, tmp_path, tube):
    tube.ready.update({i: json.dumps({"k": i, "v": f"x{i}", "more": 1}).encode() for i in range(1, 11)} | {11: b"no json"})
    query = queue_job(spark, tmp_path, tube)
    until(query, lambda: not tube.ready and len(tube.deleted) >= 7)
    want = sorted([(i, f"x{i}") for i in range(1, 11)] + [(None, None)], key=str)
    assert rows(spark.read.parquet(str(tmp_path / "out.parquet"))) == want
    # the last batch was written; its jobs come again to the next run, which knows them
    query = queue_job(spark, tmp_path, tube)
    tube.ready[12] = json.dumps({"k": 12, "v": "late"}).encode()
    until(query, lambda: not tube.ready)
    assert rows(spark.read.parquet(str(tmp_path / "out.parquet"))) == sorted([*want, (12, "late")], key=str)
    assert set(range(1, 8)) <= set(tube.deleted)


def test_a_queue_batch_is_repeated_from_its_offset(spark, tmp_path, tube):
    tube.ready.update({i: json.dumps({"k": i, "v": "x"}).encode() for i in range(1, 4)})
    query = queue_job(spark, tmp_path, tube)
    until(query, lambda: not tube.ready)
    for f in (tmp_path / "place" / "commits").glob("*"):  # as if the run had ended within the batch
        f.unlink()
    tube.ready.clear()  # the queue itself has forgotten its jobs
    query = queue_job(spark, tmp_path, tube)
    until(query, lambda: False, most=2)
    assert rows(spark.read.parquet(str(tmp_path / "out.parquet"))) == [(1, "x"), (2, "x"), (3, "x")]


def database(spark, tmp_path, n=100):
    catalog = Catalog(spark, [{"name": "q", "driver": "sqlite", "path": str(tmp_path / "t.db"), "rows": 30}])
    write(catalog, "q.t", spark.range(n).selectExpr("id AS k", "if(id % 10 = 3, null, 'v' || id % 7) AS v", "id / 4 AS x"), "insert", [], [], None)
    return catalog


def test_filters_reach_the_statement(spark, tmp_path):
    df = database(spark, tmp_path).read("q.t").where("k >= 40 AND v IN ('v1', 'v2') AND x < 20.5 AND length(v) = 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "length(v" in plan and "40" not in plan and "v1" not in plan  # Spark is left with what SQLite was not asked
    want = [(k, f"v{k % 7}", k / 4) for k in range(40, 82) if k % 7 in (1, 2) and k % 10 != 3]
    assert rows(df) == sorted(want, key=str)


def test_a_failed_write_leaves_the_database(spark, tmp_path):
    catalog = database(spark, tmp_path, 10)
    bad = spark.range(20).selectExpr("id + 100 AS k", "if(id = 19, raise_error('no'), 'w') AS v", "0D AS x").repartition(4)
    with pytest.raises(Exception, match="no"):
        write_sqlite(bad, catalog.databases["q"], "t")
    assert catalog.read("q.t").count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t.db"]


def test_modes_change_only_what_differs(spark, tmp_path):
    catalog = database(spark, tmp_path, 10)
    with sqlite3.connect(tmp_path / "t.db") as c:
        kept = dict(c.execute("SELECT k, rowid FROM t"))
    new = spark.createDataFrame([(1, "v1", 0.25), (2, "other", 0.5), (50, "new", 1.0)], "k long, v string, x double")
    status = write(catalog, "q.t", new, "sync", ["k"], [], lambda df: df["k"] < 5)
    assert (status["inserted"], status["updated"]) == (1, 1)
    with sqlite3.connect(tmp_path / "t.db") as c:
        now = dict(c.execute("SELECT k, rowid FROM t"))
        assert c.execute("SELECT v FROM t WHERE k = 2").fetchone() == ("other",)
    assert sorted(now) == [1, 2, 5, 6, 7, 8, 9, 50]
    assert all(now[k] == kept[k] for k in (1, 5, 6, 7, 8, 9))


def committed(folder, monkeypatch, table, rows, staged, keys):
    """Commits staged rows (columns, then _op) to a new table; gives its rows and the hundreds of SQLite's steps."""
    folder.mkdir()
    path, stage, steps = str(folder / "t.db"), str(folder / "stage"), []
    with sqlite3.connect(path) as c:
        c.execute(f"CREATE TABLE t ({table})")
        c.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(rows[0]))})", rows)
    with sqlite3.connect(stage) as c:
        c.execute("CREATE TABLE rows (k, v, _op)")
        c.executemany("INSERT INTO rows VALUES (?, ?, ?)", staged)
    real = sqlite3.connect

    def counting(*args, **more):
        made = real(*args, **more)
        made.set_progress_handler(lambda: steps.append(1), 100)
        return made

    monkeypatch.setattr(stores.sqlite3, "connect", counting)
    SqliteWriter({"path": path, "table": "t", "keys": ",".join(keys)}, T.StructType().add("k", "long").add("v", "string").add("_op", "string"), False).commit([Staged(stage, len(staged))])
    monkeypatch.undo()
    with sqlite3.connect(path) as c:
        return c.execute("SELECT k, v FROM t").fetchall(), len(steps)


def test_steps_of_a_sync_grow_with_its_rows(tmp_path, monkeypatch):
    """Every second row is deleted or replaced; four times the rows take four times the steps, with the square of the rows it was sixteen."""
    taken = []
    for n in (500, 2000):
        staged = [(i, "new", None if i >= n else "delete" if i % 3 else "put") for i in range(0, n + 10, 2)]
        got, steps = committed(tmp_path / str(n), monkeypatch, "k INTEGER, v TEXT", [(i, "old") for i in range(n)], staged, ["k"])
        assert sorted(got) == sorted([(i, "old") for i in range(1, n, 2)] + [(k, v) for k, v, op in staged if op != "delete"])
        taken.append(steps)
    assert taken[1] < 6 * taken[0]


def test_steps_of_an_update_of_several_keys_grow_with_its_rows(tmp_path, monkeypatch):
    """Keys of two columns, nulls among them, compare as the table's columns do: here without regard to case."""
    taken = []
    for n in (400, 1600):
        before = [(None if i == 8 else i // 2, "aB"[i % 2]) for i in range(n)]
        staged = [(None if k is None else str(k), v.swapcase(), "put") for k, v in before[::4]]
        got, steps = committed(tmp_path / str(n), monkeypatch, "k INTEGER, v TEXT COLLATE NOCASE", before, staged, ["k", "v"])
        want = [r for i, r in enumerate(before) if i % 4] + [(k, "A") for k, _ in before[::4]]
        assert sorted(got, key=str) == sorted(want, key=str)
        taken.append(steps)
    assert taken[1] < 6 * taken[0]


def test_steps_of_an_upsert_grow_with_its_rows(tmp_path, monkeypatch):
    """Every row of a table with twins is replaced once, as many are new."""
    taken = []
    for n in (400, 1600):
        staged = [(i, "new", "put" if i < n else None) for i in range(2 * n)]
        got, steps = committed(tmp_path / str(n), monkeypatch, "k INTEGER, v TEXT", [(i, v) for v in "xy" for i in range(n)], staged, ["k"])
        assert sorted(got) == [(i, "new") for i in range(2 * n)]
        taken.append(steps)
    assert taken[1] < 6 * taken[0]


def test_steps_of_an_update_grow_with_its_rows_whatever_is_known_of_the_table(tmp_path, monkeypatch):
    """SQLite keeps the sizes of the last ANALYZE: here the table had one row; keys that are null have their own passes."""
    taken = []
    for n in (500, 2000):
        path, stage = str(tmp_path / f"{n}.db"), str(tmp_path / f"{n}.stage")
        old = [(i // 2, "ab"[i % 2]) for i in range(n)] + [(None, "a"), (5, None), (None, None), (None, None), (None, "kept"), (n, None)]
        new = [(k, v) for k, v in old[:n:4]] + [(None, "a"), (5, None), (None, None)]
        with sqlite3.connect(path) as c:
            c.execute("CREATE TABLE t (k INTEGER, v TEXT, w TEXT)")
            c.execute("INSERT INTO t VALUES (-1, 'a', 'old')")
            c.execute("ANALYZE")
            c.executemany("INSERT INTO t VALUES (?, ?, 'old')", old)
        with sqlite3.connect(stage) as c:
            c.execute("CREATE TABLE rows (k, v, w, _op)")
            c.executemany("INSERT INTO rows VALUES (?, ?, 'new', 'put')", new)
        real, steps = sqlite3.connect, []

        def counting(*args, real=real, steps=steps, **more):
            made = real(*args, **more)
            made.set_progress_handler(lambda: steps.append(1), 100)
            return made

        monkeypatch.setattr(stores.sqlite3, "connect", counting)
        schema = T.StructType().add("k", "long").add("v", "string").add("w", "string").add("_op", "string")
        SqliteWriter({"path": path, "table": "t", "keys": "k,v"}, schema, False).commit([Staged(stage, len(new))])
        monkeypatch.undo()
        with sqlite3.connect(path) as c:
            got = c.execute("SELECT k, v, w FROM t").fetchall()
        want = [(-1, "a", "old"), *((k, v, "old") for k, v in old if (k, v) not in set(new)), *((k, v, "new") for k, v in new)]
        assert sorted(got, key=str) == sorted(want, key=str)
        taken.append(len(steps))
    assert taken[1] < 6 * taken[0]


@pytest.mark.parametrize("bad", [False, True])
def test_an_upsert_of_more_tasks_than_files_may_be_open(tmp_path, bad):
    """Rows of tasks follow each other; a row that the table refuses leaves it as it was, and no file is left."""
    path, n = str(tmp_path / "t.db"), 80
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (k INTEGER, v TEXT CHECK (v <> 'bad'))")
        c.executemany("INSERT INTO t VALUES (?, 'old')", [(i,) for i in range(0, 3 * n, 2)])
    staged = [Staged(str(tmp_path / f"stage-{p}"), 2) for p in range(n)]
    for p, s in enumerate(staged):
        with closing(sqlite3.connect(s.path)) as c, c:
            c.execute("CREATE TABLE rows (k, v, _op)")
            c.executemany("INSERT INTO rows VALUES (?, ?, ?)", [(2 * p, "new", "put"), (2 * p + 1, "bad" if bad and p == n - 1 else "new", None)])
    schema = T.StructType().add("k", "long").add("v", "string").add("_op", "string")
    writer = SqliteWriter({"path": path, "table": "t", "keys": "k"}, schema, False)
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 40, limits[1]))
    try:
        with pytest.raises(sqlite3.IntegrityError) if bad else nullcontext():
            writer.commit([*staged, None])
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    with closing(sqlite3.connect(path)) as c:
        got = c.execute("SELECT k, v FROM t ORDER BY rowid").fetchall()
    old = [(i, "old") for i in range(0, 3 * n, 2)]
    assert got == (old if bad else [r for r in old if r[0] >= 2 * n] + [(k, "new") for k in range(2 * n)])
    assert [p.name for p in tmp_path.iterdir()] == ["t.db"]


def test_a_function_gets_the_request(spark):
    catalog, asked = Catalog(spark), []

    def source(s, tests, request):
        asked.append(request)
        return s.range(5).selectExpr("id AS k", "id AS v", "id AS w")

    catalog.register_function("source", source)
    config = {"input": "&.=@source::k", "schema": {"k": "$.k", "x": ["@add", "$.v", 1]}, "querys": {"k": {">=": 2}}, "orders": [["$.k", True]]}
    assert rows(Job.from_config(spark, config, catalog=catalog).plan()) == [(2, 3), (3, 4), (4, 5)]
    assert asked == [{"fields": ["k", "v"], "filters": {"k": {">=": 2}}, "orders": [("k", -1)], "cursor": None}]


def test_a_lookup_function_is_asked_once_for_each_key(spark, tmp_path):
    catalog, folder = Catalog(spark), str(tmp_path)
    catalog.put("m.t", spark.createDataFrame([(i, i % 7 if i % 5 else None, [i % 3, 1]) for i in range(60)], "i long, k long, ks array<long>").repartition(4))

    def answer(keys):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(" ".join(str(r["k"]) for r in keys))
        return [{"k": r["k"], "v": n} for r in keys if r["k"] != 6 for n in range(2 if r["k"] == 5 else 1)]

    catalog.register_lookup("f", answer, "k long, v long", batch=3)
    schema = {"i": "$.i", "n": ["$.k", "&.=@f::k", [":@len", "$.v"]], "m": ["$.ks", "&.=@f::k", [":@sum", "$.k"]]}
    got = {r["i"]: (r["n"], r["m"]) for r in Job.from_config(spark, {"input": "&.m.t", "schema": {"i": "$.i", "n": ["$.k", "&.=@f::k", [":@sum", "$.v"]], "m": schema["m"]}}, catalog=catalog).plan().collect()}
    for i in range(60):
        k = i % 7 if i % 5 else None
        assert (got[i][0] or 0) == (1 if k == 5 else 0)
        assert got[i][1] == i % 3 + 1
    calls = [f.read_text().split() for f in tmp_path.iterdir()]
    assert all(len(c) <= 3 for c in calls)


@pytest.mark.parametrize("most", [100_000, 4])
def test_rows_meet_a_whole_table(spark, monkeypatch, most):
    from weftline.plans import compiler

    monkeypatch.setattr(compiler, "LISTED", most)
    catalog = Catalog(spark)
    catalog.put("m.a", spark.range(7).select(F.col("id").alias("x")))
    catalog.put("m.b", spark.range(11).select(F.col("id").alias("y")))
    plan = lambda ref: Job.from_config(spark, {"input": "&.m.a", "schema": {"x": "$.x", "y": [ref, ":$.y"]}}, catalog=catalog).plan()
    assert rows(plan("&&.m.b")) == sorted([(x, y) for x in range(7) for y in range(11)], key=str)
    if most > 11:
        assert rows(plan("&.m.b"))[0] == (0, list(range(11)))
    else:
        with pytest.raises(ValueError, match="too many"):
            plan("&.m.b")


def test_a_registered_sink(spark):
    from weftline.sinks import register_sink

    taken = []
    register_sink("bucket", lambda df, options, table, mode, keys: taken.append((options["at"], table, mode, keys, rows(df))) or {"stored": df.count()})
    databases = [{"name": "b", "driver": "bucket", "at": "there"}]
    status = Job.from_config(spark, {"databases": databases, "input": [{"a": 1}, {"a": 2}], "output": "&.b.t::a use UI", "schema": {"a": "$.a"}}).run()
    assert taken == [("there", "t", "upsert", ["a"], [(1,), (2,)])]
    assert status == {"mode": "upsert", "stored": 2}
