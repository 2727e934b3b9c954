"""Near-duplicate documents: DartMinHash signatures, banded joining, exact checks, classes.

A document is the weighted set of its runs of five words, weighted by how often
each occurs.  DartMinHash throws hashed darts into the region (weight up to the
element's, rank up to a limit) of every element: the region is cut into areas
whose sides double, each area holds a Poisson number of darts that is hashed from
element and area, and so are the darts' places.  Each dart falls into one of k
coordinates, and the signature keeps the earliest rank of each.  Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity,
and with the limit t = k (ln k + 2) over the total weight hardly more than t darts
are looked at, whatever the length of the document.

Coordinates are banded into bucket keys.  Only distinct texts are compared: in
each bucket all members with two of them, the one with the most company and the least hash;
pairs of at least the asked similarity, checked on the texts, are links.

A bucket whose members are then in several classes is open: a member outside its
largest class may still be like any other member.  Comparing all of them would
grow with the square of the bucket, so :func:`_undecided` finds the possible pairs
among the members of open buckets from their rarest runs (prefix filter), which
loses none.  No pair that shares a bucket stays undecided.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import fresh, map_text, shared_folder, written
from weftline.llm.graphs import components
from weftline.llm.hashing import mix, shingles, weighted_jaccard

BANDS, ROWS, WORDS, SIMILARITY = 20, 6, 5, 0.8
WIDEST = 1024
#: Lengths within this factor share a class of lengths.
STEP = 1.05
#: A text that makes up at least this share of the rows is a frequent one: there are at most 1 / FREQUENT of them.
FREQUENT = 1e-4

_CDF: dict[float, np.ndarray] = {}
_UNIT = 1.0 / (1 << 53)


def _poisson(mean: float) -> np.ndarray:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as they differ from 1."""
    if mean not in _CDF:
        last = int(mean + 12 * math.sqrt(mean) + 30)
        logs = [-mean + k * math.log(mean) - math.lgamma(k + 1) for k in range(last)]
        _CDF[mean] = np.cumsum(np.exp(logs))
    return _CDF[mean]


def _sides(limit: float) -> list[tuple[float, float]]:
    """[0, 1), [1, 2), [2, 4), ... up to a limit: (start, width); widths stop doubling at WIDEST."""
    out, at, width = [], 0.0, 1.0
    while at < limit:
        out.append((at, width))
        at, width = at + width, min(max(at + width, 1.0), WIDEST)
    return out


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * _UNIT


def darts(hashes: np.ndarray, weights: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(dart, rank) of all darts in the elements' regions up to a rank."""
    names, ranks = [], []
    for v, (low, wide) in enumerate(_sides(float(weights.max()))):
        some = weights > low
        h, w = hashes[some], weights[some]
        for r, (first, long) in enumerate(_sides(limit)):
            seed = mix(h + np.uint64((v * 64 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            n = np.searchsorted(_poisson(wide * long), _uniform(seed), side="right")
            each = np.repeat(np.arange(len(h)), n)
            if not len(each):
                continue
            number = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(seed[each] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            rank = first + long * _uniform(mix(dart + np.uint64(1)))
            keep = rank < limit
            if wide > 1 or low > 0:  # whole weights fill the first side
                keep &= low + wide * _uniform(dart) < w[each]
            names.append(dart[keep])
            ranks.append(rank[keep])
    return np.concatenate(names), np.concatenate(ranks)


def signature(hashes: np.ndarray, weights: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The earliest rank in each of k coordinates; weights are whole numbers from 1."""
    limit = k * (math.log(k) + 2) / float(weights.sum())
    while True:
        out = np.full(k, np.inf)
        dart, rank = darts(hashes, weights, limit) if len(hashes) else (np.empty(0, np.uint64), np.empty(0))
        np.minimum.at(out, (mix(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64), rank)
        if np.isfinite(out).all():
            return out
        limit *= 2


def bucket_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    parts = sig.view(np.uint64).reshape(bands, rows)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return out.view(np.int64)


def signed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, digest, keys): a digest of the text and its bucket keys; none for a text without words."""

    def make():
        def one(i, text):
            if text is None:
                return i, None, []
            digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
            hashes, counts = shingles(text, words)
            return i, digest, bucket_keys(signature(hashes, counts, bands * rows), bands, rows).tolist() if len(hashes) else []

        return one

    return map_text(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)), "id", text_col, "id long, digest binary, keys array<long>", make)


def _represented(sign: DataFrame) -> DataFrame:
    """(id, rep, keys): the smallest id with the same text; keys for those that stand for themselves.

    Only texts that occur again take part in a join.  The frequent ones are few by
    definition and are broadcast, so no task gets all copies of one text.
    """
    again = sign.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    often = F.col("n") >= FREQUENT * sign.count()
    marked = sign.join(F.broadcast(again.where(often).select("digest", F.col("rep").alias("known"))), "digest", "left")
    rare = marked.where(F.col("known").isNull()).join(again.where(~often).select("digest", "rep"), "digest", "left")
    frequent = marked.where(F.col("known").isNotNull()).withColumn("rep", F.col("known"))
    both = rare.unionByName(frequent).select("id", F.coalesce("rep", "id").alias("rep"), "keys")
    return both.withColumn("keys", F.when(F.col("id") == F.col("rep"), F.col("keys")))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, hashes, counts): the runs of each text as binaries, computed once; no counts if each occurs once."""

    def make():
        def one(i, text):
            hashes, counts = shingles(text or "", words)
            return i, hashes.astype("<u8").tobytes(), b"" if (counts == 1).all() else counts.astype("<i4").tobytes()

        return one

    return map_text(texts, "id", "text", "id long, hashes binary, counts binary", make)


def _set(hashes: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes.as_buffer(), "<u8")
    return h, np.frombuffer(counts.as_buffer(), "<i4") if len(counts.as_buffer()) else np.ones(len(h), np.int32)


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the similarity."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"hashes_{x}"), F.col("counts").alias(f"counts_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "hashes_a", "counts_a", "hashes_b", "counts_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in range(2, 6)), strict=True)
            ok = [weighted_jaccard(_set(h, c), _set(i, d)) >= similarity for h, c, i, d in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _runs(sets: DataFrame) -> DataFrame:
    """(rep, own, out, n, tok) for every run of a text: the k-th coming of a run is an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes, counts = _set(batch.column(3)[row], batch.column(4)[row])
                n = int(counts.sum())
                at = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
                tok = mix(np.repeat(hashes, counts) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                same = [pa.repeat(batch.column(c)[row], n) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.repeat(pa.scalar(n, pa.int32()), n), pa.array(tok)], names=["rep", "own", "out", "n", "tok"])

    return sets.select("rep", "own", "out", "hashes", "counts").mapInArrow(run, "rep long, own long, out boolean, n int, tok long")


def _undecided(bucketed: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, base: str) -> DataFrame:
    """All pairs (a, b) that may be links between members of open buckets, one of them outside its bucket's largest class.

    Two texts of n and m runs that are similar enough share at least
    s / (1 + s) (n + m) of them.  With runs in one order for all, the rarest first, they
    then share one among the first n + 1 less that number of the one, and likewise of the
    other.  How many these are depends on the partner's length, so texts meet by
    (run, class of lengths, class of the partner's lengths).  A text that is unlike
    its bucket's centre has more runs of its own than that; what is common to the bucket
    is looked at by few, however large the bucket is.
    """
    held = roots.select(F.col("node").alias("rep"), F.col("root").alias("own"))
    owned = bucketed.where(F.col("n") > 2).join(held, "rep", "left").select("key", "rep", F.coalesce("own", "rep").alias("own"))
    sizes = owned.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"))
    # written, so that Spark can split the join where a bucket is large
    leads = written(sizes.groupBy("key").agg(F.max(F.struct("n", "own")).alias("most"), F.count(F.lit(1)).alias("classes")).where(F.col("classes") > 1).select("key", F.col("most.own").alias("lead")), "leads", base)
    members = owned.join(leads, "key").groupBy("rep").agg(F.first("own").alias("own"), F.max(F.col("own") != F.col("lead")).alias("out"))
    runs = written(_runs(sets.withColumnRenamed("id", "rep").join(members, "rep")), "runs", base)

    shared = runs.groupBy("tok").agg(F.count(F.lit(1)).alias("f"), F.max("out").alias("asked")).where(F.col("f") > 1)
    mine = Window.partitionBy("rep", "n")  # rows of one id with other texts may share it; their places are then too early, which loses nothing
    n, s = F.col("n"), F.lit(float(similarity))
    place = n - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("f", "tok")) - 1
    first = runs.join(shared, "tok").withColumn("at", place).where(F.col("asked") & (F.col("at") <= n - s * n + 1))

    def bin_of(length: Column) -> Column:
        return F.floor(F.log(length) / math.log(STEP)).cast("int")

    spread = first.withColumn("mine", bin_of(n.cast("double"))).withColumn("theirs", F.explode(F.sequence(bin_of(F.greatest(s * n - 0.001, F.lit(1.0))), bin_of(n / s + 0.001))))
    least = F.greatest(s * n, F.exp(F.col("theirs") * math.log(STEP))) - 0.001
    needed = lambda other: F.ceil(s / (1 + s) * (n + other) - 0.001)
    keyed = written(spread.where(F.col("at") < n - needed(least) + 1).select("tok", "mine", "theirs", "rep", "own", "out", "n", "at"), "prefixes", base)

    right = keyed.select("tok", F.col("mine").alias("theirs"), F.col("theirs").alias("mine"), *[F.col(c).alias(f"{c}_y") for c in ("rep", "own", "out", "n", "at")])
    met = keyed.where("out").join(right, ["tok", "mine", "theirs"])
    once = ~F.col("out_y") | (F.col("rep") < F.col("rep_y"))
    enough = F.least(n - F.col("at"), F.col("n_y") - F.col("at_y")) >= needed(F.col("n_y"))
    found = met.where((F.col("own") != F.col("own_y")) & once & enough)
    return found.select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) for each row with an id: documents linked by copies or near copies share the smallest id.

    Equal texts are copies, empty ones too.  A null text, and a text without words
    that has no copy, is alone.  Texts of fewer than five words are compared as
    one run of all their words.  Rows with the same id are one document and give
    one row each; rows with a null id have no place in a class and give none.
    """
    spark, base = df.sparkSession, shared_folder(df.sparkSession)
    sign = written(signed(df, id_col, text_col, words, bands, rows).where(F.col("id").isNotNull()), "signed", base)
    members = written(_represented(sign), "members", base)
    keyed = members.select("rep", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min_by("rep", F.xxhash64("key", "rep")).alias("other"), F.count(F.lit(1)).alias("n"))
    heads = written(first.where(F.col("n") > 1), "heads", base)
    shared = written(keyed.join(heads, "key"), "shared", base)
    # the head of a bucket is the member with the most company in all its buckets: of copies with changes, the one they come from
    company = shared.groupBy("rep").agg(F.sum("n").alias("company"))
    ranked = shared.where(F.col("n") > 2).join(company, "rep").groupBy("key").agg(F.max(F.struct("company", "rep")).alias("best"))
    central = written(ranked.select("key", F.col("best.rep").alias("head")), "central", base)
    bucketed = written(shared.join(central, "key", "left").withColumn("head", F.coalesce("head", "other")), "bucketed", base)
    wanted = bucketed.select(F.col("rep").alias("id")).distinct().hint("merge")  # grows with the table: the same plan at every size
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = written(_sets(source.join(wanted, "id", "left_semi"), words), "sets", base)

    def pairs_of(x: str, y: str) -> DataFrame:
        return bucketed.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    links = written(_checked(pairs_of("rep", "head").union(pairs_of("rep", "other")).distinct(), sets, similarity), "links", base)
    roots = components(links, f"{base}/first")
    more = written(_checked(_undecided(bucketed, roots, sets, similarity, base), sets, similarity), "more", base)
    joined = components(links.unionByName(more), f"{base}/second").select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    return members.join(joined, "rep", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "rep").alias("class_id"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows and columns of ``df``, one document of each class: the one with the smallest id, null last.

    Rows are told apart by id and text: those that repeat both are one document,
    of which one row stays, and those that share an id, or have none, are compared
    by their texts.  Rows with neither id nor text all stay, and so would different
    rows whose 64-bit keys are equal, which a second hash tells.
    """
    base = shared_folder(df.sparkSession)
    key, other, least, many = fresh(df, "key", "check", "least", "many")
    keyed = df.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col))).withColumn(other, F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)))
    none = F.col(id_col).isNull() & F.col(text_col).isNull()
    counted = keyed.where(~none).groupBy(key).agg(F.min(id_col).alias(least), F.count(F.lit(1)).alias(many), (F.min(other) != F.max(other)).alias("clash"))
    keys = written(counted, "keys", base)
    clashing = keys.where("clash").select(key)  # hardly ever any
    apart = keyed.where(~none).join(clashing, key, "left_semi")
    keys = keys.where(~F.col("clash"))
    repeated, texts = keys.where(F.col(many) > 1).select(key), keyed.where(~none).join(clashing, key, "left_anti").select(key, text_col)
    single = texts.join(repeated, key, "left_anti").unionByName(texts.join(repeated, key, "left_semi").dropDuplicates([key]))
    found = classes(single, key, text_col, **parameters).join(keys, key)
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col(least).isNull().alias("last"), least, key, many)).alias("first"))
    kept = keyed.where(~none).join(written(first.select(f"first.{key}", f"first.{many}"), "kept", base), key)
    once = kept.where(F.col(many) == 1)
    again = kept.where(F.col(many) > 1).dropDuplicates([key])
    return once.unionByName(again).select(*df.columns).unionByName(keyed.where(none).select(*df.columns)).unionByName(apart.select(*df.columns))
