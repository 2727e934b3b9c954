"""Periodic runs, benchmark passages and centroids, against brute force."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from weftline.llm import centroids, decontaminate, queries, runs

SPLIT = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w, least=12):
    ends = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                ends.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in ends.items())


def words_of_runs(doc_id, text):
    w = SPLIT.findall(text or "")
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    return w


def brute_report(doc_id, text):
    w = words_of_runs(doc_id, text)
    found = brute_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def some_sequence(rng, letters, n):
    w = []
    while len(w) < n:
        root = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        w += (root * 9)[: rng.randint(1, 40)]
    return w[:n]


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        w = some_sequence(rng, rng.choice([1, 2, 3, 5]), rng.randint(0, 70))
        least = rng.choice([1, 2, 6, 12])
        assert runs.find(w, least) == brute_runs(w, least)


def test_stretches_lose_no_run():
    rng = random.Random(6)
    for _ in range(500):
        texts = [some_sequence(rng, rng.choice([2, 4, 30]), rng.randint(0, 90)) for _ in range(4)]
        group = np.repeat(np.arange(4), [len(t) for t in texts])
        flat = np.array([x for t in texts for x in t], np.int32)
        starts = np.cumsum([0, *map(len, texts)])
        got = sorted((s + a, n, q) for a, b in runs.stretches(flat, group) for s, n, q in runs.find(flat[a:b].tolist()))
        assert got == [(int(starts[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in brute_runs(t)]


def test_runs_table(spark):
    rng = random.Random(7)
    text = lambda *a: " ".join(f"w{x}" for x in some_sequence(rng, *a))
    table = [(i, text(rng.choice([2, 3, 9]), rng.randint(1, 150))) for i in range(120)]
    table += [(None, None), (None, "x " * 30), (5, ""), (6, " \t\n"), (7, " ".join("ab" * 9)), (8, "\x0b\x0ca\x0ba\x1ca " * 9), (9, "ü ü ü é " * 40), (9, "ü ü ü é " * 40), (10, text(40, 3000) + " " + "la " * 500)]
    df = spark.createDataFrame([(*r, 1, 2) for r in table], "doc_id long, text string, runs int, n_words int")
    got = sorted((tuple(r) for r in runs.report(df).collect()), key=str)
    assert got == sorted((brute_report(*r) for r in table), key=str)
    assert runs.report(df.limit(0)).count() == 0


def test_runs_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in queries.op13_runs(spark, sf).collect()}
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(table)
    for doc_id, text in table:
        if len(words_of_runs(doc_id, text)) < 1500:  # brute force is quadratic
            assert got[doc_id] == brute_report(doc_id, text)


def brute_clusters(table, k, dim, rounds, seed):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in table if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))
    cents = [v for _, v in first[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            cents[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    return [(i, n, d, inertia[n], sum(inertia.values()), sha(",".join(map(str, cents[n])))) for i, d, n in found]


def test_clusters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    table = [(i, rng.normal(i % 5, 0.3, 64).astype(float).tolist()) for i in range(300)]
    table += [(i, table[i % 7][1]) for i in range(300, 360)]  # copies and ties
    table += [(None, [0.0] * 64), (1, None), (2, [1.0] * 63), (3, [None] + [1.0] * 63), (4, [math.nan] * 64), (5, [math.inf] * 64), (5, [-0.0005] * 64), (5, [-0.0005] * 64)]
    df = spark.createDataFrame([(*r, 0) for r in table], "vec_id long, embedding array<double>, cluster int").repartition(5)
    got = sorted((tuple(r) for r in centroids.report(df).collect()), key=str)
    assert got == sorted(brute_clusters(table, 8, 64, 10, 3), key=str)
    assert centroids.report(df.limit(0)).count() == 0
    few = df.where("vec_id in (11, 12, 13)")
    assert sorted((tuple(r) for r in centroids.report(few).collect()), key=str) == sorted(brute_clusters([r for r in table if r[0] in (11, 12, 13)], 8, 64, 10, 3), key=str)


def test_large_components_stay_exact(spark):
    table = [(i, [float((i * 7919 + j * 104729) % 1000 + 2.0**20)] * 64) for i in range(20) for j in range(3)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in centroids.report(df).collect()), key=str)
    assert got == sorted(brute_clusters(table, 8, 64, 10, 3), key=str)
    far = spark.createDataFrame([(1, [2.0**51] * 64), (2, [-(2.0**51)] * 64), (3, [2.0**52] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in centroids.report(far, k=1).collect()) == [1, 2]
    assert {r["distance"] for r in centroids.report(far, k=1).collect()} == {None}  # beyond a long


@pytest.mark.parametrize("dim", [3, 8, 20])
def test_partial_distances_choose_the_nearest(dim):
    rng = np.random.default_rng(dim)
    x, c = rng.integers(-9, 9, (500, dim)), rng.integers(-9, 9, (12, dim))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    cluster, best = centroids.nearest(x, c, rng.permutation(dim))
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def brute_hits(docs, items, window=10):
    words = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    cuts = {}
    for i, t in items:
        w = words(t)
        for at in range(max(len(w) - window + 1, 1) if w else 0):
            cuts.setdefault(tuple(w[at : at + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for at in range(len(w)):
            for n in {len(c) for c in cuts}:
                if at + n <= len(w) and (c := tuple(w[at : at + n])) in cuts:
                    hit |= set(range(at, at + n))
                    found |= cuts[c]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def test_benchmark_passages_are_those_of_brute_force(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(n))
    items = [(i, say(rng.choice([3, 6, 10, 11, 14, 40]))) for i in range(30)]
    items += [(30, items[0][1]), (30, items[3][1]), (None, "Été à l'École"), (31, "ΑΣ'Α x"), (32, None), (33, ""), (34, "-- !"), (35, "One"), (36, "alpha")]
    docs = [(i, say(rng.randint(1, 60))) for i in range(60)]
    docs += [(100 + i, f"{say(4)}. {items[i][1].upper()}, {say(5)}") for i in range(30)]
    docs += [(200, "ÉTÉ été À l ÉCOLE"), (201, "Été-à/L'École!"), (202, "ΑΣ'Α X"), (203, None), (204, ""), (205, "ONE"), (None, items[5][1]), (None, items[5][1]), (206, (items[4][1] + " | ") * 300)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rid int, n int").repartition(3)
    bench = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, n int")
    got = sorted((tuple(r) for r in decontaminate.report(df, bench).collect()), key=str)
    assert got == sorted(brute_hits(docs, items), key=str)
    none = decontaminate.report(df, bench.limit(0))
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in none.collect()} == {(0, 0, False)} and none.count() == len(docs)
    assert decontaminate.report(df.limit(0), bench).count() == 0


def test_shingles_past_the_bitmap_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BITS", 64)  # lets nearly everything through
    rng = random.Random(10)
    say = lambda n: " ".join(str(rng.randrange(4)) for _ in range(n))
    items, docs = [(i, say(rng.choice([5, 9, 12]))) for i in range(20)], [(i, say(80)) for i in range(20)]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute_hits(docs, items), key=str)


def test_decontamination_runs_no_python(spark):
    sf = "/root/testdata/sf0.001"
    for df in (queries.op12_decontaminate(spark, sf), *decontaminate.occurrences(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
