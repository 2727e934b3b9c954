"""Folds and windows whose order matters, over groups that are larger than an array may be."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import register_fold
from weftline.plans import scan
from weftline.plans.job import Job
from weftline.sources import Catalog


@pytest.fixture(params=[1 << 16, 40])
def chunk(request, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", request.param)


def table(n=300, seed=3):
    rng = random.Random(seed)
    keys = [None, "a", "hot", "hot", "hot", "b"]
    rows = [(rng.choice(keys), i * 3, rng.choice([None, *range(9)]), rng.randrange(5)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def plan(spark, rows, schema, **more):
    catalog = Catalog(spark)
    catalog.put("m.t", spark.createDataFrame(rows, "k string, seq long, v long, w long").repartition(5))
    return Job.from_config(spark, {"input": "&.m.t", "schema": schema, "options": {"sequence": "seq"}} | more, catalog=catalog).plan().collect()


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def number(state, v):
    return (0 if state is None else state) * 3 + (0 if v is None else v)


def test_folds_in_order(spark, chunk):
    rows = table()
    register_fold("test::chain", lambda state, v: (state or 0) * 7 % 1009 + int(v), "long")
    schema = {
        "k": "$.k",
        "h": ["#aggregate", "$.k", ["@mod", ["@add", ["@mul", ["@add", "$.h", 0], 3], "$$.v"], 1000003]],
        "u": ["#aggregate", "$.k", ["@test::chain", "$.u", "$$.w"]],
        "n": ["#aggregate", "$.k", ["@add", "$.n", 1]],
    }
    got = {r["k"]: (r["h"], r["u"], r["n"]) for r in plan(spark, rows, schema)}
    want = {}
    for k, members in grouped(rows).items():
        h = u = 0
        for _, _, v, w in members:
            h, u = number(h, v) % 1000003, u * 7 % 1009 + w
        want[k] = (h, u, len(members))
    assert got == want


@pytest.mark.parametrize("down", [False, True])
def test_windows_in_order(spark, chunk, down):
    rows = table()
    calc = ["@mod", ["@add", ["@mul", ["@add", "$.state", 0], 3], "$.value", ["@mul", "$.context.current_index", "$.context.current_data.w"]], 9973]
    schema = {"seq": "$.seq", "x": ["#partition", "$.k", {"valuer": "$.w", "orders": [["w", down]]}, "$.v", calc], "all": ["#partition", "$.k", None, "$.v", ["@mod", ["@add", ["@mul", ["@add", "$.state", 0], 3], "$.value"], 9973]]}
    got = {r["seq"]: (r["x"], r["all"]) for r in plan(spark, rows, schema)}
    want = {}
    for members in grouped(rows).values():
        whole = 0
        for r in members:
            whole = number(whole, r[2]) % 9973
        state = 0
        for i, r in enumerate(sorted(members, key=lambda r: -r[3] if down else r[3])):
            state = (number(state, r[2]) + i * r[3]) % 9973
            want[r[1]] = (state, whole)
    assert got == want


def test_folds_of_nothing(spark, chunk):
    schema = {"k": "$.k", "h": ["#aggregate", "$.k", ["@mod", ["@add", ["@mul", "$.h", 3], "$$.v"], 7]]}
    assert plan(spark, [], schema) == []


def test_a_long_group_needs_one_array_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 12000)
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'x' || id, 'hot') AS k", "id AS seq", "id % 11 AS v", "id AS w")
    catalog = Catalog(spark)
    catalog.put("m.t", df)
    schema = {"k": "$.k", "h": ["#aggregate", "$.k", ["@mod", ["@add", ["@mul", ["@add", "$.h", 0], 3], "$$.v"], 1000003]]}
    out = Job.from_config(spark, {"input": "&.m.t", "schema": schema, "options": {"sequence": "seq"}}, catalog=catalog).plan()
    h = 0
    for i in range(60_000):
        if i % 3:
            h = (h * 3 + i % 11) % 1000003
    assert out.where("k = 'hot'").first()["h"] == h
    assert out.count() == 20_001


def variables(rows, start, step):
    out, state = [], start
    for r in rows:
        state = step(state, r)
        out.append(state)
    return out


def test_variables_over_blocks(spark):
    n = 140_000  # more than two blocks of places
    df = spark.range(n).selectExpr("id AS seq", "if(id % 7 = 3, null, id % 5) AS v", "id * 7919 % 1000 AS w").repartition(6)
    catalog = Catalog(spark)
    catalog.put("m.t", df)
    low = ["@lt", "$$.w", 5]
    schema = {
        "seq": "$.seq",
        "since": ["#assign", "since", ["#if", low, "$$.v", ["@sub", ["@add", "$.since", "$$.v"], 1]]],
        "sign": ["#assign", "sign", ["@mul", "$.sign", ["#if", low, -1, 1]]],
        "from": ["#assign", "from", ["@sub", "$$.w", "$.from"]],
        "top": ["#assign", "top", ["#if", low, "$.top", ["@max", "$.top", "$$.w"]]],
    }
    job = Job.from_config(spark, {"input": "&.m.t", "schema": schema, "options": {"sequence": "seq"}, "variables": {"since": None, "sign": 3, "from": 1, "top": None}}, catalog=catalog)
    got = [tuple(r) for r in job.plan().orderBy("seq").collect()]
    rows = [(None if i % 7 == 3 else i % 5, i * 7919 % 1000) for i in range(n)]

    def since(s, r):
        if r[1] < 5:
            return r[0]
        s = r[0] if s is None else s + (r[0] or 0)
        return -1 if s is None else s - 1

    want = zip(
        range(n),
        variables(rows, None, since),
        variables(rows, 3, lambda s, r: -s if r[1] < 5 else s),
        variables(rows, 1, lambda s, r: r[1] - s),
        variables(rows, None, lambda s, r: s if r[1] < 5 else max(r[1], -1 if s is None else s)),
        strict=True,
    )
    assert got == list(want)


def test_variables_of_any_step_and_order(spark, chunk):
    rows = [(f"{i:04}", i % 9) for i in range(200)]
    catalog = Catalog(spark)
    catalog.put("m.t", spark.createDataFrame(rows, "seq string, v long").repartition(4))
    schema = {"seq": "$.seq", "h": ["#assign", "h", ["@mod", ["@add", ["@mul", "$.h", 3], "$$.v"], 101]], "n": ["#assign", "n", ["@mul", "$.n", ["#if", ["@eq", "$$.v", 4], -1, 1]]]}
    job = Job.from_config(spark, {"input": "&.m.t", "schema": schema, "options": {"sequence": "seq"}, "variables": {"h": 1, "n": 1}}, catalog=catalog)
    got = [tuple(r) for r in job.plan().orderBy("seq").collect()]
    assert got == list(zip([r[0] for r in rows], variables(rows, 1, lambda s, r: (s * 3 + r[1]) % 101), variables(rows, 1, lambda s, r: -s if r[1] == 4 else s), strict=True))


def wide_rows(rows):
    """The rule itself: a new row where the id changes or a key comes again."""
    out, last = [], None
    for i, k, v in rows:
        if not out or i != last or k in out[-1]:
            out.append({"id": i})
        out[-1][k], last = v, i
    return sorted((tuple(r.get(n) for n in ("id", "A", "B", "C")) for r in out), key=str)


@pytest.mark.parametrize("named", [True, False])
def test_keys_out_of_turn(spark, chunk, named):
    from weftline.operators.shape import h4v

    rng = random.Random(4)
    rows = [(1, "A", 1), (1, "B", 2), (1, "A", 3), (1, "A", 4), (1, "B", 5)]
    for _ in range(60):
        i = rng.choice([1, 2, None, 3])
        rows += [(i, rng.choice("ABC"), rng.randrange(99)) for _ in range(rng.randint(1, 6))]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "at long, id long, k string, v long").repartition(4)
    got = h4v(df, "k", "v", *(["id"] if named else []), columns=["A", "B", "C"], order="at")
    want = wide_rows(rows) if named else [r[1:] for r in wide_rows([(0, *r[1:]) for r in rows])]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def no_array_over(monkeypatch, most):
    """From now on sorted lists of more rows fail."""
    real = F.array_sort
    monkeypatch.setattr(F, "array_sort", lambda c, *a: real(F.when(F.size(c) > most, F.raise_error(F.lit("a long array"))).otherwise(c), *a))


def test_runs_of_ids_far_apart_meet_in_no_array(spark, monkeypatch):
    """A wide row for each of 1,500 ids whose places lie far apart: only rows of one id are a list."""
    from weftline.operators.shape import h4v

    no_array_over(monkeypatch, 100)
    rows = [(i, k, i * 10 + n, i * 10_000_000_000 + n) for i in range(1500) for n, k in enumerate("AABAB")]
    df = spark.createDataFrame(rows, "id long, k string, v long, at long").repartition(4)
    got = h4v(df, "k", "v", "id", columns=["A", "B", "C"], order="at")
    want = [(i, *r) for i in range(1500) for r in ((i * 10, None, None), (i * 10 + 1, i * 10 + 2, None), (i * 10 + 3, i * 10 + 4, None))]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_runs_go_on_over_partitions(spark):
    """One id over all range partitions is one run; so is null, and an id that comes again begins a new one."""
    from weftline.operators.shape import h4v

    ids = [7] * 900 + [None] * 300 + [8] + [7] * 400
    df = spark.createDataFrame([(n, i, f"k{n}", n) for n, i in enumerate(ids)], "at long, id long, k string, v long").repartition(5)
    got = h4v(df, "k", "v", "id", columns=["k0", "k899", "k900", "k1199", "k1200", "k1201", "k1600"], order="at")
    want = [(7, 0, 899, *[None] * 5), (None, None, None, 900, 1199, *[None] * 3), (8, *[None] * 4, 1200, None, None), (7, *[None] * 5, 1201, 1600)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_prefixes_of_places_far_apart_meet_in_no_array(spark, monkeypatch):
    """3,600 rows over the 64 bits of a place, below zero too, are summed up in lists of at most 60."""
    no_array_over(monkeypatch, 60)
    places = [(a << 50) + (b << 34) for a in range(-30, 30) for b in range(60)]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(places)], "at long, v long").repartition(4)
    got = scan.prefixes(df, F.col("at"), F.col("at"), F.col("v"), T.LongType(), F.lit(0).cast("long"), lambda f, g: f + g, "s")
    assert sorted(tuple(r) for r in got.select("at", "s").collect()) == [(p, i * (i + 1) // 2) for i, p in enumerate(places)]


@pytest.mark.parametrize(
    ("test", "keeps"),
    [
        (["@lte", "$.n", 3], lambda n, v: n <= 3),
        (["@gt", 3, "$.n"], lambda n, v: n < 3),
        (["@and", ["@gte", "$.v", 1], ["@eq", "$.n", 2]], lambda n, v: n == 2 and (v or 0) >= 1),
        (["@and", ["@lt", "$.v", 4], ["@lte", "$.n", 2]], lambda n, v: n <= 2 and (v or 0) < 4),
    ],
)
def test_first_places_of_a_key_are_kept_by_each_task(spark, test, keeps):
    """Of one key with all rows, only those asked for are shuffled."""
    rows = [(i, "all", None if i % 7 == 0 else i % 5) for i in range(400)]
    catalog = Catalog(spark)
    catalog.put("m.t", spark.createDataFrame(rows, "i long, k string, v long").repartition(4))
    schema = {"i": "$.i", "v": "$.v", "n": ["#partition", "$.k", {"valuer": "$.v", "orders": [["v", True]]}, "$.v", ["@add", "$.context.current_index", 1]]}
    got = Job.from_config(spark, {"input": "&.m.t", "schema": schema, "intercept": test, "options": {"sequence": "i"}}, catalog=catalog).plan()
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()
    placed = sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], -r[0]), reverse=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, v, n) for n, (i, _, v) in enumerate(placed, 1) if keeps(n, v))


def test_a_bound_of_a_column_keeps_null(spark):
    catalog = Catalog(spark)
    catalog.put("m.t", spark.createDataFrame([(None,), (-2,), (0,), (2,), (3,), (4,)], "v long"))
    for test, want in ((["@lte", "$.v", 3], {None, -2, 0, 2, 3}), (["@lt", "$.v", 3], {None, -2, 0, 2}), (["@gte", "$.v", 3], {3, 4}), (["@lte", "$.v", 0], {None, 0}), (["@or", ["@lte", "$.v", 2], ["@eq", "$.v", 4]], {None, -2, 0, 2, 4})):
        out = Job.from_config(spark, {"input": "&.m.t", "schema": {"v": "$.v"}, "intercept": test}, catalog=catalog).plan()
        plain = {r[0] for r in out.collect()}
        assert plain == want, test
