"""Near duplicates, components, nearest neighbours, mixing, personal data and the pipeline, against brute force."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import imi, mixing, neardup, pii
from weftline.llm.graphs import components
from weftline.llm.hashing import shingles, weighted_jaccard
from weftline.llm.queries import tokenizer_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def grouped(pairs):
    out = {}
    for i, c in pairs:
        out.setdefault(c, []).append(i)
    return sorted(sorted(x) for x in out.values())


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    u = Union()
    for a, b in links:
        u.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {n: u.root(n) for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_agree_as_weighted_jaccard_says():
    rng = np.random.default_rng(1)
    for n, new, most in ((200, 40, 1), (60, 10, 3), (3, 1, 1)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[:new] = rng.integers(0, 2**63, new).astype(np.uint64)
        x, y = rng.integers(1, most + 1, n), rng.integers(1, most + 1, n)
        true = weighted_jaccard((np.sort(a), x[np.argsort(a)]), (np.sort(b), y[np.argsort(b)]))
        agree = (neardup.signature(a, x, 3000) == neardup.signature(b, y, 3000)).mean()
        assert abs(agree - true) < 0.04


def test_near_duplicates_are_the_brute_force_classes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = docs.select("doc_id", "text").collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in texts}
    u = Union()
    for i, a in enumerate(texts):
        u.root(a["doc_id"])
        for b in texts[:i]:
            if a["text"] == b["text"] or weighted_jaccard(sets[a["doc_id"]], sets[b["doc_id"]]) >= 0.8:
                u.join(a["doc_id"], b["doc_id"])
    got = neardup.classes(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: u.root(i) for i in sets}


def test_near_duplicates_lose_no_link(spark):
    """Of all pairs of at least the similarity, found by counting shared runs, at least 0.99 are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null")
    texts = sorted({(r["text"], r["doc_id"]) for r in docs.select("doc_id", "text").collect()})
    sets = [shingles(t) for t, _ in texts]
    names = np.concatenate([h for h, _ in sets])
    own = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    order = np.argsort(names, kind="stable")
    names, own = names[order], own[order]
    shared: dict[tuple[int, int], int] = {}
    ends = np.flatnonzero(np.diff(names)) + 1
    for group in np.split(own, ends):
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                shared[int(a), int(b)] = shared.get((int(a), int(b)), 0) + 1
    close = [(a, b) for (a, b), n in shared.items() if n >= 0.5 * min(len(sets[a][0]), len(sets[b][0])) and texts[a][0] != texts[b][0]]
    true = [(texts[a][1], texts[b][1]) for a, b in close if weighted_jaccard(sets[a], sets[b]) >= 0.8]
    class_of = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert len(true) > 100 and sum(class_of[a] == class_of[b] for a, b in true) >= 0.99 * len(true)


def test_near_duplicates_of_a_large_split_group(spark):
    """Copies of one text with ever more words changed: classes are those of brute force, and few pairs are compared."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(260):
        words = list(base)
        for at in rng.choice(150, k % 9, replace=False):
            words[at] = f"x{k // 2}_{at}"
        texts.append(" ".join(words))
    sets, u = [shingles(t) for t in texts], Union()
    for i in range(len(texts)):
        u.root(i)
        for j in range(i):
            if weighted_jaccard(sets[i], sets[j]) >= 0.8:
                u.join(i, j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == {i: u.root(i) for i in range(len(texts))}


def test_near_duplicate_chain_and_edges(spark):
    """A chain whose ends are not alike is one class, however the buckets' heads fall."""
    base = [f"w{i}" for i in range(200)]
    chain = []
    for k in range(6):
        words = list(base)
        words[5 * k : 5 * k + 5] = [f"x{k}_{j}" for j in range(5)]
        base = words
        chain.append(" ".join(words))
    data = [(10 + i, t) for i, t in enumerate(chain)] + [(30, chain[2]), (31, "other words of no one else at all"), (1, None), (2, None), (3, ""), (4, ""), (5, "one two"), (6, "one, two"), (None, "x y z"), (7, "a " * 40000), (7, "a " * 40000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, key string")
    got = neardup.classes(df).collect()
    assert len(got) == len(data) - 1
    assert grouped({(r["doc_id"], r["class_id"]) for r in got}) == [[1], [2], [3, 4], [5, 6], [7], [10, 11, 12, 13, 14, 15, 30], [31]]
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 10, 31]
    assert neardup.classes(df.limit(0)).count() == 0


def brute_neighbours(vectors, queries, k):
    out = []
    for q in queries:
        scored = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = {i: np.round(rng.normal(size=8), 3) for i in range(400)}
    for i in range(100, 160):
        vectors[i] = vectors[3]  # a large group of copies
    data = [(i, [float(x) for x in v], 1) for i, v in vectors.items()]
    data += [(900, None, 1), (1000, [0.0] * 8, 1), (1100, [float("nan")] * 8, 1), (1200, [None] * 8, 1), (1300, [1.0], 1), (5, data[5][1], 1), (None, data[5][1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int")
    got = imi.search(df, F.col("vec_id") % 50 == 0, share=1.0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == brute_neighbours(vectors, range(0, 400, 50), 10)
    few = imi.search(df.where("vec_id < 4"), F.lit(True)).collect()
    assert len(few) == 4 * 3
    assert imi.search(df.limit(0), F.lit(True)).count() == 0


def recalled(spark, df, by=100):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids, matrix = np.array(sorted(vectors)), np.array([vectors[i] for i in sorted(vectors)])
    want = set()
    for q in (i for i in vectors if i % by == 0):
        far = np.sqrt(((matrix - vectors[q]) ** 2).sum(1))
        order = [int(ids[k]) for k in np.lexsort((ids, far)) if ids[k] != q][:10]
        want |= {(q, i) for i in order}
    got = {(r["query_id"], r["vec_id"]) for r in imi.search(df, F.col("vec_id") % by == 0).collect()}
    return len(got & want) / len(want)


def test_neighbours_recall(spark):
    """With the fitted share: vectors without structure, in few and many dimensions, and the test table."""
    rng = np.random.default_rng(11)
    made = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=24)]) for i in range(4000)], "vec_id long, embedding array<double>")
    assert recalled(spark, made) >= 0.9
    assert recalled(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9
    unit = rng.normal(size=(12_000, 128))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    wide = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit)], "vec_id long, embedding array<double>")
    assert recalled(spark, wide, by=200) >= 0.9


def test_clustered_vectors_need_a_small_share():
    rng = np.random.default_rng(12)
    points = np.repeat(rng.normal(size=(200, 32)), 30, axis=0) + rng.normal(size=(6000, 32)) * 0.05
    both = [imi.kmeans(points[:, :16], 35), imi.kmeans(points[:, 16:], 35)]
    assert imi.fitted_share(points, both, 16, 10) < 0.25
    flat = rng.normal(size=(2000, 32))
    assert 0.3 < imi.fitted_share(flat, [imi.kmeans(flat[:, :16], 27), imi.kmeans(flat[:, 16:], 27)], 16, 10) <= 1


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    left, right, counts = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
    cells = imi.cells_in_order(left, right, counts, 10**9)
    sums = [left[c // 7] + right[c % 7] for c in cells]
    assert sums == sorted(sums) and len(cells) == (counts > 0).sum()
    some = imi.cells_in_order(left, right, counts, 20)
    assert some == cells[: len(some)] and sum(counts[divmod(c, 7)] for c in some) >= 20


def test_mixing(spark):
    data = [(i, "big" if i % 10 else "small", i) for i in range(4000)] + [(None, None, 0), (1, "big", 1)]
    df = spark.createDataFrame(data, "doc_id long, source string, mix_copy long")
    weights = {"big": 0.5, "small": 0.5}
    out = mixing.mix(df, weights).cache()
    by = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(by["big"] - 2000) < 200 and abs(by["small"] - 2000) < 300 and None not in by
    copies = out.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("mix_copy").alias("m"))
    assert copies.where("n <> m and doc_id <> 1").count() == 0
    keys = [r["mix_key"] for r in out.collect()]
    assert keys == sorted(keys)
    assert rows(out.select("doc_id", "mix_copy")) == rows(mixing.mix(df.repartition(7), weights).select("doc_id", "mix_copy"))
    assert mixing.mix(df.limit(0)).count() == 0
    rate = mixing.mix(spark.createDataFrame([(i, "s") for i in range(30)], "doc_id long, source string").union(spark.range(30000).selectExpr("id + 100", "'b'")), {"s": 1.0, "b": 0.0})
    assert abs(rate.count() - 30030) < 1500  # a rate of 1001 is drawn in parts


@pytest.mark.parametrize("doc_id", ["null", "5", "id % 40"])
def test_rows_without_ids_of_their_own_draw_for_themselves(spark, doc_id):
    df = spark.range(6000).selectExpr(f"cast({doc_id} as long) AS doc_id", "'text ' || id % 300 AS text", "'s' AS source")
    got = mixing.mix(df, {"s": 1.0}, partitions=8)
    assert 5600 < got.count() < 6400  # a Poisson sum of mean 6000
    keys = got.groupBy("mix_key").count()
    assert keys.where("count > 1").count() == 0
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1200
    assert rows(got) == rows(mixing.mix(df.repartition(3), {"s": 1.0}, partitions=8))


def test_mixing_query_moves_whole_documents(spark):
    """The rows behind the result are documents, as often and in the order as it lists them."""
    from weftline.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.op9_mixing(spark, sf)
    listed = [(r["doc_id"], r["mix_copy"], r["mix_key"]) for r in out.collect()]
    assert [k for _, _, k in listed] == sorted(k for _, _, k in listed)
    table = spark.read.parquet(*out.inputFiles())
    assert table.columns == [*docs.columns, "mix_rate", "mix_copy", "mix_key"]
    assert rows(table.select("doc_id", "mix_copy", "mix_key")) == sorted(listed, key=str)
    assert table.select(docs.columns).exceptAll(docs.join(table.select("doc_id"), "doc_id").select(docs.columns)).count() == 0


def brute_spans(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data_is_the_brute_force_spans(spark):
    import random

    rnd = random.Random(3)
    texts = []
    for k in range(1500):
        letters = rnd.choice(["abc@.-_+ ", "0123456789 -", "1.2.25.256.0 ", "+1 (988) 555-24", "ab1@.c+-5 6🙂é"])
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        texts.append(x + (rnd.choice([" 4041894974608795 ", " 4041 8949 7460 8795", " a@b.c.d@e.fg", " +1 (784) 555-9263 ", " 042.144.35.254", "4429526289707589-"]) + x if k % 3 == 0 else ""))
    texts += [None, "", "a" * 200000, "1" * 100000, "a@" + "b." * 20000 + "c", "+1" + " " * 50000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        if t is None or len(t) < 1000:
            want = brute_spans(t or "")
            assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
            assert got[i]["n_email"] == sum(w.startswith("email") for w in want)
            assert got[i]["spans"].startswith(",".join(want))
    assert got[len(texts) - 2]["spans"] == "email:0:40003"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for i, t in enumerate(texts[:200]):
        hit = set()
        for w in got[i]["spans"].split(",") if got[i]["spans"] else []:
            _, a, b = w.split(":")
            hit |= set(range(int(a), int(b)))
        kept = "".join(c for p, c in enumerate(t) if p not in hit)
        assert clean[i].replace("[removed]", "") == kept
    assert clean[1500] is None and pii.redact(df).columns == df.columns
    assert pii.report(df.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    """Ids that stand where emails stand are found; the same shapes elsewhere are not."""
    data = [(i, f"please write to user{i}@mail.example.com today") for i in range(20)]
    data += [(100, "please write to agent007 today"), (101, "room 12 on floor 3"), (102, "please write to agent007 today"), (102, "please write to agent007 today")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[100] == "email_context:16:24" and got[102] == got[100] and got[101] == ""


def test_contexts_hold_beside_other_identifiers(spark):
    """An unseen id directly after another identifier, after a number, or before an identifier is found."""
    data = [(i, f"contact user{i}@mail.example.com +1 (555) 010-{1000 + i} soon") for i in range(20)]
    data += [(20 + i, f"unit {i} other{i}@mail.example.com") for i in range(20)]
    data += [(40 + i, f"from 10.0.0.{i} mine{i}@mail.example.com 10.1.1.{i}") for i in range(20)]
    data += [(100, "contact someone@mail.example.com AB-12 soon"), (101, "unit 4 AB12"), (102, "from 10.2.2.2 AB77 10.3.3.3"), (103, f"contact {'long' * 20}@mail.example.com AB-13 now")]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert "phone_context:33:38" in got[100] and "email_context:7:11" in got[101] and "email_context:14:18" in got[102] and "phone_context:106:111" in got[103]


def test_keys_are_found_by_label_and_by_spelling(spark):
    """Keys under a label, and keys that begin alike, are found with the unlike ones among them; keys alone and UUIDs are not."""
    import random

    rnd = random.Random(5)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    data = [(i, f"w{hexa(2)} password=a1{hexa(14)}b2 v{hexa(2)}") for i in range(12)]
    data += [(20 + i, f"x{hexa(3)} QRST{''.join(rnd.choice('AB1C2D3E4') for _ in range(12))}1A2B y{hexa(3)}") for i in range(12)]
    data += [(100, "some password=open today"), (101, "new password=short1 here"), (102, "uv QRSTABCDEFGHIJKLMNOP wx"), (103, "alone a1b2c3d4e5f6a7b8c9 here"), (104, "id 550e8400-e29b-41d4-a716-446655440000 end")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[i].startswith("secret:13:") for i in range(12)) and all(got[20 + i].startswith("secret:5:") for i in range(12))
    assert got[101] == "secret_context:13:19" and got[102] == "secret_context:3:23"
    assert got[100] == got[103] == got[104] == ""


def test_keys_are_found_in_documents(spark):
    """Of the keys planted in the test table, told apart by their own formats, nearly all are found, and nothing else is learned."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = re.compile(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}", re.I)
    want = {(r["doc_id"], m.start(), m.end()) for r in docs.where("text is not null").collect() for m in known.finditer(r["text"])}
    got = set()
    for r in pii.report(docs).where("n_learned > 0").collect():
        for s in r["spans"].split(","):
            kind, start, end = s.split(":")
            if kind.startswith("secret"):
                got.add((r["doc_id"], int(start), int(end)))
    assert len(want) > 50 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_many_identifiers_in_one_text(spark):
    import time

    text = "mail a1@b.co now +1 (555) 010-1234 " * 20000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.report(df).first()
    assert row["n_email"] == row["n_phone"] == 20000
    clean = pii.redact(df).first()["text"]
    assert clean == "mail [removed] now [removed] " * 20000
    assert time.time() - began < 120


def test_pii_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.occurrences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_copies(docs, seed=7):
    """How often each document comes: the Poisson distribution of its source's rate, inverted at its hashed point."""
    size = {}
    for _, source in docs:
        size[source] = size.get(source, 0) + 1
    total = sum(n**0.5 for n in size.values())
    out = {}
    for i, source in docs:
        rate = size[source] ** 0.5 / total * len(docs) / size[source]
        u = (int(hashlib.md5(f"{seed}|{i}|0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p, below, n = math.exp(-rate), math.exp(-rate), 0
        while u >= below and n < 200:
            n += 1
            p *= rate / n
            below += p
        out[i] = n
    return out


def test_pipeline_against_its_parts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        if name == "near_duplicates":
            before = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(before.values()))
        if name == "personal_data":
            texts = {r["doc_id"]: r for r in out.collect()}
            assert all(r["n_chars"] == len(r["text"]) and not brute_spans(r["text"]) for r in texts.values())
            assert len(texts) == docs.count()
        if name == "mixing":
            copies = brute_copies([(r["doc_id"], r["source"]) for r in docs.collect()])
            assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
        docs = out.cache()
    library = Tokenizer.from_file(tokenizer_path())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids))
    assert rows(corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")) == sorted(want, key=str)


def test_pipeline_keeps_clean_rows_and_takes_odd_ones(spark):
    rows_ = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs away {i * 7} times", "en", "s", 1) for i in range(20)]
    odd = [(50, None, "en", "s", 0), (51, "### !!", "en", None, 6), (None, "words without any id here", "en", "s", 1), (52, "words " * 20000, None, "s", 1)]
    docs = spark.createDataFrame([*rows_, *odd], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name == "language":
            assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.collect()) == [-1, *range(20), 52]
    assert docs.count() > 0


def test_pipeline_without_labels_keeps_clean_rows(spark):
    texts = [(1, "a clean text", None), (2, None, None), (3, "### 12", None), (4, "another one", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["language"]
    assert rows(stage(spark, docs, "").select("doc_id", "lang")) == [(1, None), (4, None)]
    letterless = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "en"))
    assert rows(stage(spark, letterless, "").select("doc_id")) == [(1,), (4,)]


def test_null_and_clashing_ids_are_compared_by_text(spark):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:-1], "x"])
    data = [(None, "a b c"), (None, "a b c"), (None, "d e f"), (None, None), (None, None), (5, "a b c"), (7, "first of two"), (7, "second of the two"), (7, "first of two"), (9, " ".join(words)), (None, near), (9, "g h i"), (10, "second of the two")]
    kept = neardup.deduplicated(spark.createDataFrame(data, "doc_id long, text string"))
    want = [(None, "d e f"), (None, None), (None, None), (5, "a b c"), (7, "first of two"), (7, "second of the two"), (9, " ".join(words)), (9, "g h i")]
    assert rows(kept) == sorted(want, key=str)


def test_sql_of_the_queries(spark):
    from weftline.llm import queries

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = [r.asDict() for r in queries.queries()[name](spark, "/root/testdata/sf0.001").collect()]
        cur = con.sql(sql)
        want = [dict(zip(cur.columns, r, strict=True)) for r in cur.fetchall()]
        key = lambda r: str(sorted(r.items()))
        a, b = sorted(got, key=key), sorted(want, key=key)
        assert [{k: v for k, v in r.items() if not isinstance(v, float)} for r in a] == [{k: v for k, v in r.items() if not isinstance(v, float)} for r in b]
        for x, y in zip(a, b, strict=True):
            assert all(v == pytest.approx(y[k]) for k, v in x.items() if isinstance(v, float))
