"""Rules of the language on small fixtures: nulls, zeroes, casts, scopes, yields, folds."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.config import merged, plain, querys, substitute
from weftline.functions import FUNCTIONS, call
from weftline.lang.casts import cast, date_pattern
from weftline.lang.values import Value, literal
from weftline.plans.job import Job
from weftline.sources import Catalog


def value(spark, v: Value):
    return spark.range(1).select(v.col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "args", "expected"),
    [
        ("add", (None, 2), 2), ("add", (1, 2.5), 3.5), ("add", ("a", 1), "a1"), ("sub", (None, 3), -3), ("mul", (None, 3), 3), ("div", (None, 4), -4),
        ("div", (7, 0), 0), ("mod", (7, 0), 0), ("mod", (-5, 3), 1), ("mod", (5, -3), -1), ("gt", (-1, 0), 1), ("eq", (None, 0), 1), ("eq", ("", 0), 1),
        ("gte", (0, None), 1), ("lt", (0, 5), 1), ("neq", (1, 2), 1), ("empty", ("x",), 1), ("empty", ("",), 0), ("not", (0,), True), ("max", (1, None, 5), 5),
        ("substring", ("hello", 1, -1), "ell"), ("substring", ("hello", -3, 100), "llo"), ("split", ("a.b", "."), ["a", "b"]), ("join", ([1, None, 2], "-"), "1-None-2"),
        ("len", ("abc",), 3), ("len", (["a", "bb"],), [1, 2]), ("abs", ("-2.5",), 2.5), ("index", ([3, 4, 5], 4), 4), ("filter", ([1, 2, 1], 1), [1, 1]), ("sum", ([1, 2, 3],), 6),
        ("sort", ([3, None, 1],), [None, 1, 3]), ("range", (3,), [0, 1, 2]), ("range", (5, 1, -2), [5, 3]), ("range", (3, 3), []), ("neg", ("abc",), "cba"), ("bit", ("<<", 1, 4), 16), ("bit", ("&", 7, 0), 0),
        ("string::zfill", ("-7", 4), "-007"), ("string::center", ("ab", 5, "*"), "**ab*"), ("string::swapcase", ("aBc",), "AbC"), ("string::partition", ("a=b=c", "="), ["a", "=", "b=c"]),
        ("string::rpartition", ("a=b=c", "="), ["a=b", "=", "c"]), ("string::isalpha", ("ab1",), False), ("array::min", ([3, 1, 2],), 1), ("array::insert", ([1, 3], 1, 2), [1, 2, 3]),
        ("math::sqrt", (-1,), 0.0), ("math::gcd", (12, 18), 6), ("math::factorial", (5,), 120), ("hash::md5", ("a", "b"), "187ef4436122d1cc2f40dc2b92f0eba0"), ("re::sub", ("b+", "x", "abbc"), "axc"),
        ("re::match", ("b", "abc"), None), ("re::search", ("(b)c", "abc", 1), "b"), ("textline::split", ('a "b c" [d e] f', " "), ["a", "b c", "d e", "f"]), ("convert_int", (None,), 0), ("convert_string", (None,), ""),
        ("string::split", ("a.b.c", ".", 1), ["a", "b.c"]), ("string::rsplit", ("a.b.c", ".", 1), ["a.b", "c"]), ("string::find", ("abcabc", "b", 2), 4), ("string::expandtabs", ("ab\tc\n\td", 4), "ab  c\n    d"),
        ("re::findall", ("(a)(\\d)", "a1 a2"), [["a", "1"], ["a", "2"]]), ("is_null", (None,), 1), ("and", (1, 0), 0), ("or", (0, 5), 5), ("in", (2, [1, 2]), 1), ("contain", ("abc", "z"), 0),
    ],
)
def test_functions(spark, name, args, expected):
    assert value(spark, call(name, [literal(a) for a in args])) == expected


@pytest.mark.parametrize(
    ("v", "text", "expected"),
    [
        ("12", "int", 12), ("1.9", "int", 1), ("abc", "int", 0), (None, "int", None), ("abc", "float", 0.0), (1.5, "str", "1.500000"), (True, "str", "true"), (7, "str %03d", "007"),
        ("false", "bool", True), ("", "bool", False), (0, "bool", False), ("20240102030405", "datetime", datetime.datetime(2024, 1, 2, 3, 4, 5)), ("nonsense", "datetime", None),
        ("2024-01-02", "date", datetime.date(2024, 1, 2)), ("030405", "time", "03:04:05"), ("03:04:05", "time", "03:04:05"), (5, "array", [5]), ("zz", "objectid", "0" * 24), ([1, 1, 2], "set", [1, 2]), (["1", "x"], "int", [1, 0]),
    ],
)
def test_casts(spark, v, text, expected):
    assert value(spark, cast(literal(v), text)) == expected


def test_date_patterns():
    assert date_pattern("%Y-%m-%d") == "yyyy-MM-dd"
    assert date_pattern("%Hh%M") == "HH'h'mm"


def test_all_names_are_registered():
    call("add", [literal(1), literal(2)])
    assert len(FUNCTIONS) >= 80


def job(spark, rows, types, config, **tables):
    catalog = Catalog(spark)
    catalog.put("m.in", spark.createDataFrame(rows, types))
    for name, (r, t) in tables.items():
        catalog.put(f"m.{name}", spark.createDataFrame(r, t))
    return Job.from_config(spark, {"input": "&.m.in"} | config, catalog=catalog)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_parcels_job_with_yield_lookups_and_folds(spark):
    """Couriers of parcels from a split list, in one row each, with names and finished ways by lookups."""
    parcels = [(1, "k1,k2", 2.0, "x"), (2, "k1", 3.5, "y"), (3, "k3,k9", 1.0, "x"), (4, "", 7.0, "x")]
    couriers = [("k1", "Ada", 10), ("k2", "Bo", 0), ("k3", "Cy", 30)]
    stops = [("k1", 5, 1), ("k1", 9, 0), ("k2", 4, 1), ("k3", 2, 1), ("k3", 6, 1)]
    each = lambda calc: ["#yield", ["@split", "$.names", ","], [":#aggregate", "$", calc]]
    config = {
        "predicate": ["@neq", "$.names", ""],
        "schema": {
            "courier": each("$$"),
            "name": each(["$$", "&.m.couriers::code", ":$.name"]),
        },
        "options": {"unique": ["m.couriers"]},
    }
    got = job(spark, parcels, "id long, names string, weight double, way string", config, couriers=(couriers, "code string, name string, pay long"), stops=(stops, "code string, km long, done int")).plan()
    assert rows(got) == [("k1", "Ada"), ("k2", "Bo"), ("k3", "Cy"), ("k9", None)]
    far = ["$.code", "&.m.stops::code", [":#foreach", "$.*|array", ["#if", ["@eq", "$.done", 0], "#continue", ["#make", {"value": "$.km"}]], [":@sum", "$.*|array", "value"]]]
    kind = {"#case": "$.pay", ":0": "none", "#end": ["#if", ["@gt", "$.pay", 20], "high", "low"]}
    made = job(spark, couriers, "code string, name string, pay long", {"schema": {"code": "$.code", "far": far, "kind": kind}}, stops=(stops, "code string, km long, done int")).plan()
    assert [(r[0], float(r[1]), r[2]) for r in rows(made)] == [("k1", 5.0, "low"), ("k2", 4.0, "none"), ("k3", 8.0, "high")]


def test_loop_marks_keep_their_values(spark):
    marked = lambda head: ["#foreach", "$.a", ["#if", ["@eq", "$._value_", 3], [head, 99], "$._value_"]]
    bare = ["#foreach", "$.a", ["#if", ["@eq", "$._value_", 3], "#break", "$._value_"]]
    df = job(spark, [([1, 3, 5],)], "a array<long>", {"schema": {"c": marked("#continue"), "b": marked("#break"), "n": bare}}).plan()
    assert rows(df) == [([1, 99, 5], [1, 99], [1])]


def test_literal_rows_as_input(spark):
    made = Job.from_config(spark, {"input": [{"a": 1, "b": "x"}, {"a": 5}], "querys": {"a": {">": 0}}, "schema": {"a": "$.a", "b": "$.b"}})
    assert rows(made.plan()) == [(1, "x"), (5, None)]


def test_lookup_by_a_list_of_keys(spark):
    one = job(spark, [([1, 3],), ([1, 3],), ([],), ([9],)], "ks array<long>", {"schema": {"ks": "$.ks", "v": ["$.ks", "&.m.r::k", ":$.v"]}}, r=([(1, "a"), (1, "b"), (3, "c")], "k long, v string")).plan()
    got = {tuple(r["ks"]): r["v"] or [] for r in one.collect()}
    assert one.count() == 4 and got == {(1, 3): ["a", "b", "c"], (): [], (9,): []}


def test_unique_lookups_read_only_what_is_used(spark):
    from weftline.queries import QUERIES

    plan = QUERIES["flagship"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "orders.parquet" in line]
    assert scans and all("o_totalprice" not in line.split("Batched")[0] and "o_orderpriority" not in line.split("Batched")[0] for line in scans), scans


def test_ids_are_unique_over_many_partitions(spark):
    made = call("snowflakeid", [])
    ids = spark.range(0, 3000, 1, 1500).select(made.col.alias("i"))
    assert ids.distinct().count() == 3000 and ids.where("i <= 0").count() == 0
    given = call("snowflakeid", [literal(0), literal(3), literal(4)])
    row = spark.range(0, 6, 1, 3).select(given.col.alias("i")).collect()
    assert len({r["i"] for r in row}) == 6 and all((r["i"] >> 12) & 1023 == 3 * 32 + 4 for r in row)
    with pytest.raises(ValueError, match="0 to 31"):
        call("snowflakeid", [literal(0), literal(32)])


def test_draws_and_seen_places(spark):
    drawn = value(spark, call("random::choices", [literal([7, 8]), literal(5)]))
    assert len(drawn) == 5 and set(drawn) <= {7, 8}
    places = {"x": ["#partition", "$.k", {"valuer": "$.v", "orders": [["$.v", False]]}, "$.v", ["@add", ["@mul", "$.context.current_index", 100], "$.value"]]}
    df = job(spark, [(1, 10), (1, 20), (1, 30)], "k long, v long", {"schema": {"v": "$.v", **places}}).plan()
    assert [r[1] for r in rows(df)] == [10, 120, 230]


def test_yaml_forms_equal_json():
    assert plain({"#yield": ["$.sites", {"return": ["#aggregate", "$.*|int", "$$.*|int"]}]}) == ["#yield", "$.sites", [":#aggregate", "$.*|int", "$$.*|int"]]
    assert plain({"#match": {"<<": "$.a", "/2/": "$.b", ">>": "$.c"}}) == {"#match": "$.a", "/2/": "$.b", "#end": "$.c"}


def test_lookup_list_and_expansion(spark):
    left, right = [(1,), (2,), (3,)], [(1, "a"), (1, "b"), (3, "c")]
    one = job(spark, left, "k long", {"schema": {"k": "$.k", "v": ["$.k", "&.m.r::k", ":$.v"]}}, r=(right, "k long, v string")).plan()
    assert rows(one) == [(1, ["a", "b"]), (2, None), (3, ["c"])]
    many = job(spark, left, "k long", {"schema": {"k": "$.k", "v": ["$.k", "&&.m.r::k", ":$.v"]}}, r=(right, "k long, v string")).plan()
    assert rows(many) == [(1, "a"), (1, "b"), (2, None), (3, "c")]


def test_equal_lookups_are_one_join(spark):
    config = {"schema": {"a": ["$.k", "&.m.r::k", ":$.v"], "b": ["$.k", "&.m.r::k", ":$.w"]}, "options": {"unique": ["m.r"]}}
    df = job(spark, [(1,)], "k long", config, r=([(1, "a", "b")], "k long, v string, w string")).plan()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Python" not in plan


def test_yields(spark):
    data = [(1, [1, 2, 3], ["x"]), (2, [1], []), (3, None, ["p", "q"])]
    df = job(spark, data, "id long, a array<long>, b array<string>", {"schema": {"id": "$.id", "a": ["#yield", "$.a"], "b": ["#yield", "$.b"]}}).plan()
    assert rows(df) == [(1, 1, "x"), (1, 2, "x"), (1, 3, "x"), (3, None, "p"), (3, None, "q")]


def test_scope_errors(spark):
    with pytest.raises(ValueError, match="outermost"):
        job(spark, [(1,)], "k long", {"schema": {"x": "$$.k"}}).plan()
    with pytest.raises(ValueError, match="unknown function"):
        job(spark, [(1,)], "k long", {"schema": {"x": ["@nope", 1]}}).plan()


def test_hidden_fields_and_hooks(spark):
    j = job(spark, [(1, 2)], "a long, b long", {"schema": {"a": "$.a", "__b__": "$.b"}})
    j.hook("loaded", lambda df: df.withColumn("a", F.col("a") + 10))
    assert [r.asDict() for r in j.plan().collect()] == [{"a": 11}]


def test_config_rules():
    base = {"databases": [{"name": "x", "driver": "csv"}], "pipelines": ["p"], "schema": {"a": 1}}
    over = {"databases": [{"name": "x", "path": "/d"}], "pipelines": ["q"], "schema": {"b": 2}}
    assert merged(base, over) == {"databases": [{"name": "x", "driver": "csv", "path": "/d"}], "pipelines": ["p", "q"], "schema": {"a": 1, "b": 2}}
    assert querys({"k": {">=": 1}}, {"k__gte": 5, "k__in": "1,2"}) == {"k": {">=": 5, "in": ["1", "2"]}}
    assert substitute({"a": ["?x", "?y"]}, {"x": 3}) == {"a": [3, "?y"]}


def test_types_are_wide(spark):
    df = job(spark, [(1, 1.5)], "a int, b float", {"schema": {"a": "$.a", "b": "$.b"}}).plan()
    assert df.schema["a"].dataType == T.LongType() and df.schema["b"].dataType == T.DoubleType()
