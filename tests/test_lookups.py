"""Lookups with conditions, against brute force."""

import datetime
import random

from weftline.plans.job import Job
from weftline.sources import Catalog

DAY = datetime.datetime(2024, 3, 1)


def test_times_within_bounds(spark):
    rng = random.Random(8)
    at = lambda: None if rng.random() < 0.1 else DAY + datetime.timedelta(hours=rng.randrange(200))
    left = [(i, rng.choice(["a", "hot", "hot", None]), at(), at()) for i in range(80)] + [(900, "hot", DAY, DAY + datetime.timedelta(days=4000)), (901, "none", DAY, DAY)]
    right = [(rng.choice(["a", "hot", "hot", "hot", "other"]), at(), n) for n in range(300)]
    catalog = Catalog(spark)
    catalog.put("m.l", spark.createDataFrame(left, "i long, k string, lo timestamp, hi timestamp").repartition(3))
    catalog.put("m.r", spark.createDataFrame(right, "k string, ts timestamp, v long"))
    within = ["@and", ["@gte", "$.ts", "$$.lo"], ["@lt", "$.ts", "$$.hi"]]
    found = ["$.k", "&.m.r::k", within]
    one_side = ["$.k", "&.m.r::k", ["@gte", "$.ts", "$$.lo"], [":@max", "$.v"]]
    schema = {"i": "$.i", "n": [*found, [":@sum", "$.*", "v"]], "list": [*found, ":$.v"], "side": one_side}
    got = {r["i"]: (r["n"], sorted(r["list"] or []), r["side"]) for r in Job.from_config(spark, {"input": "&.m.l", "schema": schema}, catalog=catalog).plan().collect()}

    def after(ts, lo):
        return lo is None if ts is None else lo is None or ts >= lo

    def before(ts, hi):
        return hi is not None if ts is None else hi is not None and ts < hi

    for i, k, lo, hi in left:
        same = [(ts, v) for key, ts, v in right if key == k]
        vs = sorted(v for ts, v in same if after(ts, lo) and before(ts, hi))
        assert got[i] == (sum(vs), vs, max((v for ts, v in same if after(ts, lo)), default=None)), i


def test_conditions_that_read_nothing_of_the_row(spark):
    catalog = Catalog(spark)
    catalog.put("m.l", spark.createDataFrame([(1,), (2,), (3,)], "k long"))
    catalog.put("m.r", spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k long, v long"))
    schema = {"k": "$.k", "s": ["$.k", "&.m.r::k", ["@gt", "$.v", 4], [":@sum", "$.v"]]}
    got = sorted(tuple(r) for r in Job.from_config(spark, {"input": "&.m.l", "schema": schema}, catalog=catalog).plan().collect())
    assert got == [(1, 12), (2, 0), (3, 0)]


def test_latest_earlier_rows_of_a_hot_key(spark, monkeypatch):
    from weftline.operators import asof

    rng = random.Random(2)
    key = lambda: rng.choice([None, 1, 2, 2, 2, 2])
    left = [(i, key(), rng.randrange(60)) for i in range(150)]
    right = [(i, key(), rng.randrange(60)) for i in range(200)]
    a, b = spark.createDataFrame(left, "i long, k long, t long").repartition(3), spark.createDataFrame(right, "j long, k long, t long")
    want = []
    for i, k, t in left:
        before = [(u, j) for j, other, u in right if other == k and u < t]
        want.append((i, max(before)[1] if before else None))
    for hot in (asof.HOT, 20):
        monkeypatch.setattr(asof, "HOT", hot)
        got = asof.asof_join(a, b, ["k"], "t", "t", ["j"], ties=["j"]).select("i", "asof_j").collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
