"""Batches, streams, states, cursors and what orders or runs through a whole table."""

import pytest
from pyspark.sql import functions as F

import weftline
from weftline.__main__ import parse, run
from weftline.plans.job import Job
from weftline.sources import Catalog

SUM = {"k": "$.k", "s": ["#aggregate", "$.k", ["@add", "$.s", "$$.v"]]}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write_files(spark, folder, n):
    for i in range(n):
        spark.createDataFrame([(i, i * 10)], "k long, v long").coalesce(1).write.mode("append").parquet(f"{folder}/rows.parquet")


def document(tmp_path, **more):
    import json

    config = {"databases": [{"name": "f", "driver": "parquet", "path": str(tmp_path)}], "input": "&.f.rows", "output": "&.f.out::k use I", "schema": {"k": "$.k", "v": "$.v"}} | more
    path = tmp_path / "job.json"
    path.write_text(json.dumps(config))
    return str(path)


def test_stream_in_batches_goes_on_where_it_was(spark, tmp_path):
    write_files(spark, tmp_path, 3)
    path = document(tmp_path)
    given = {"@batch": "1", "@recovery": str(tmp_path / "place")}
    assert run(spark, path, given)[0]["batches"] == 3
    out = str(tmp_path / "out.parquet")
    assert rows(spark.read.parquet(out)) == [(0, 0), (1, 10), (2, 20)]
    spark.createDataFrame([(7, 70)], "k long, v long").write.mode("append").parquet(f"{tmp_path}/rows.parquet")
    run(spark, path, given)
    assert rows(spark.read.parquet(out)) == [(0, 0), (1, 10), (2, 20), (7, 70)]


def test_stream_keeps_the_jobs_filters(spark, tmp_path):
    write_files(spark, tmp_path, 3)
    run(spark, document(tmp_path, querys={"k": {">": 0}}), {"@streaming": True, "@recovery": str(tmp_path / "place")})
    assert rows(spark.read.parquet(str(tmp_path / "out.parquet"))) == [(1, 10), (2, 20)]


def test_polled_input_ends_at_its_time(spark, tmp_path):
    write_files(spark, tmp_path, 2)
    path = document(tmp_path, input="&.f.rows use P", options={"period": "1 second"})
    run(spark, path, {"@timeout": "8", "@recovery": str(tmp_path / "place")})
    assert rows(spark.read.parquet(str(tmp_path / "out.parquet"))) == [(0, 0), (1, 10)]


def test_stream_of_another_source_is_refused(spark):
    with pytest.raises(ValueError, match="stream"):
        Catalog(spark, [{"name": "m", "driver": "memory"}]).stream("m.x")


def test_flags():
    assert parse(["j.json", "--@streaming", "--@batch", "5", "-v"])[1] == {"@streaming": True, "@batch": "5", "@verbose": True}


def test_cursor_pages_through_a_table(spark, tmp_path):
    spark.range(7).select(F.col("id").alias("k"), F.col("id").alias("v")).write.parquet(str(tmp_path / "rows.parquet"))
    path = document(tmp_path, cursor="k", orders=["$.k"], states=["&.s.job"], databases=[{"name": "f", "driver": "parquet", "path": str(tmp_path)}, {"name": "s", "driver": "parquet", "path": str(tmp_path)}])
    seen = []
    for _ in range(4):
        run(spark, path, {"@limit": 3, "@recovery": True})
        seen.append(spark.read.parquet(str(tmp_path / "out.parquet")).count())
    assert seen == [3, 6, 7, 7]
    state = {r["key"]: r["value"] for r in spark.read.parquet(str(tmp_path / "job.parquet")).collect()}
    assert state["@cursor"] == "6"
    again = Job.from_config(spark, path).states()
    assert again["@cursor"] == "6" and again["mode"] == "insert"


def test_states_are_read_by_expressions(spark, tmp_path):
    spark.createDataFrame([("rows", "12")], "key string, value string").write.parquet(str(tmp_path / "job.parquet"))
    config = {"databases": [{"name": "s", "driver": "parquet", "path": str(tmp_path)}], "states": ["&.s.job"], "input": [{"a": 1}], "schema": {"n": ["#state", "$.rows", "none"], "m": ["#state", "$.other", "none"]}}
    assert rows(Job.from_config(spark, config).plan()) == [("12", "none")]


def test_printed_groups_come_as_first_seen(spark, capfd):
    given = [{"k": k, "v": 1} for k in ("z", "a", "z", "m", "a")]
    job = Job.from_config(spark, {"input": given, "output": "&.stdio.&1 use I", "schema": SUM})
    assert [tuple(r) for r in job.plan().collect()] == [("z", 2), ("a", 2), ("m", 1)]


def test_running_sums_go_on_from_block_to_block(spark):
    """200,000 rows in five files' worth of partitions are several blocks; nulls add nothing, an empty table gives none."""
    catalog = Catalog(spark, [{"name": "m", "driver": "memory"}])
    catalog.put("m.t", spark.range(0, 200_000, 1, 5).select("id", F.when(F.col("id") % 7 != 0, F.col("id")).alias("v")))
    catalog.put("m.none", spark.range(0).select("id", F.col("id").alias("v")))
    schema = {"id": "$.id", "s": ["#assign", "total", ["@add", "$.total", "$$.v"]]}
    for sequence in ({}, {"options": {"sequence": "id"}}):
        config = {"input": "&.m.t", "variables": {"total": 0}, "schema": schema} | sequence
        got = {r["id"]: r["s"] for r in Job.from_config(spark, config, catalog=catalog).plan().collect()}
        total = 0
        for i in range(200_000):
            total += i if i % 7 else 0
            assert got[i] == total
    assert Job.from_config(spark, config | {"input": "&.m.none"}, catalog=catalog).plan().collect() == []


def test_generated_ids_have_their_form_and_differ(spark):
    schema = {"u": "@uuid", "o": "@objectid", "s": "@snowflakeid"}
    catalog = Catalog(spark, [{"name": "m", "driver": "memory"}])
    catalog.put("m.t", spark.range(0, 3000, 1, 1500))
    df = Job.from_config(spark, {"input": "&.m.t", "schema": schema}, catalog=catalog).plan()
    one = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns], F.min(F.length("u")).alias("lu"), F.min(F.length("o")).alias("lo"), F.min("s").alias("least")).first()
    assert (one["u"], one["s"], one["lu"], one["lo"]) == (3000, 3000, 36, 24) and one["o"] == 3000 and one["least"] > 0


def test_public_names():
    assert weftline.Job is Job and weftline.Catalog is Catalog
    assert all(getattr(weftline, n) is not None for n in weftline.__all__)
    with pytest.raises(AttributeError):
        weftline.nothing  # noqa: B018


def test_python_folds_see_values_in_order_of_arrival(spark):
    weftline.register_fold("test::trace", lambda state, value: f"{state or ''}{value}", "string")
    given = [{"k": k, "v": v} for k, v in (("a", "x"), ("b", "p"), ("a", "y"), ("a", "x"))]
    df = Job.from_config(spark, {"input": given, "schema": {"k": "$.k", "t": ["#aggregate", "$.k", ["@test::trace", "$.t", "$$.v"]]}}).plan()
    assert rows(df) == [("a", "xyx"), ("b", "p")]


def test_an_aggregate_in_an_aggregates_key_is_refused(spark):
    schema = {"n": ["#aggregate", ["#aggregate", "$.k", ["@add", "$.n", 1]], ["@add", "$.n", 1]]}
    with pytest.raises(ValueError, match="aggregate"):
        Job.from_config(spark, {"input": [{"k": 1}], "schema": schema}).plan()


def test_lambdas_of_lists(spark):
    given = [{"a": [3, 1, 2], "least": 2}]
    schema = {"kept": ["@filter", "$.a", ["#lambda", ["@gte", "$", "$$.least"]]], "down": ["@sort", "$.a", ["#lambda", ["@sub", 0, "$"]]]}
    assert rows(Job.from_config(spark, {"input": given, "schema": schema}).plan()) == [([3, 2], [3, 2, 1])]
