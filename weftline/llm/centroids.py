"""Centroid clustering of integer vectors, with partial-distance search.

Vectors become integers, floor(1024 * x).  Each round reads them in Arrow batches,
assigns each to its nearest centroid, and adds up the members of each centroid in
its task; Spark sums these few rows, and only centroids come to the driver.

The search takes the dimensions of the largest variance first.  The first block of
dimensions is summed up for all centroids, and a vector's candidate is the centroid
that is ahead there; every other centroid is then followed block by block, for the
vectors for which its sum so far is not yet strictly above their best, and only
survivors see all dimensions.  Sums are integers, so order does not change results.

Defined cases: vectors that are null, of another length, or with null or non-finite
components take no part; nor do those with a component of 2**52 or more, as a long
holds no distance to them.  A distance or an inertia beyond a long is null.  Rows that
repeat an id are vectors of their own, and ids that tie as the first centroids go by
their components.  Fewer vectors than centroids make fewer centroids, none an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024
#: Up to this size, squared differences of a vector sum up within 64 bits.
SMALL = 1 << 27
LARGE = 1 << 62
#: Dimensions of a step of the search.
BLOCK = 8


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, their integers as a matrix; objects where 64 bits may not do)."""
    lists = column.cast(pa.large_list(pa.float64()))
    at = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    flat = lists.take(pa.array(at)).flatten()
    known = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), dim).any(axis=1)
    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        known &= (np.abs(x) < LARGE // SCALE).all(axis=1)  # also false for what is not finite
        whole = np.floor(x[known] * SCALE).astype(np.int64)
    return at[known], whole if not whole.size or np.abs(whole).max() < SMALL else whole.astype(object)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, ties to the smaller number, and the squared distance to it."""
    if x.dtype == object or np.abs(centroids).max(initial=0) >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    x, centroids = x[:, order], centroids[:, order]
    k, dim = centroids.shape

    def step(rows: np.ndarray, c: int, start: int) -> np.ndarray:
        d = rows[:, start : start + BLOCK] - centroids[c, start : start + BLOCK]
        return (d * d).sum(axis=1)

    first = np.stack([step(x, c, 0) for c in range(k)])
    cluster = first.argmin(axis=0)
    d = x - centroids[cluster]
    best = (d * d).sum(axis=1)
    for c in range(k):
        at = np.flatnonzero((first[c] <= best) & (cluster != c))
        partial = first[c][at]
        for start in range(BLOCK, dim, BLOCK):
            if not len(at):
                break
            partial = partial + step(x[at], c, start)
            going = ~(partial > best[at])  # abandoned once strictly above
            at, partial = at[going], partial[going]
        better = (partial < best[at]) | ((partial == best[at]) & (c < cluster[at]))
        cluster[at[better]], best[at[better]] = c, partial[better]
    return cluster, best


def _long(value: int) -> int | None:
    return int(value) if value < 1 << 63 else None


def _moments(df: DataFrame, vec_col: str, dim: int) -> np.ndarray:
    """The dimensions by falling variance over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, s2 = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = integers(batch.column(0), dim)[1].astype(float)
            n, s, s2 = n + len(x), s + x.sum(axis=0), s2 + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n, np.int64)), pa.array(s), pa.array(s2)], names=["d", "n", "s", "s2"])

    sums = df.select(vec_col).mapInArrow(run, "d int, n long, s double, s2 double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    variance = np.zeros(dim)
    for r in sums.collect():  # one row a dimension
        variance[r["d"]] = r["s2"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0
    return np.argsort(-variance, kind="stable")


def _first(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int, seed: int) -> np.ndarray:
    """The first centroids: the vectors with the smallest hashes of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), dim)
            flat = pa.array(np.ascontiguousarray(x, np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], names=["h", "x"])

    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    hashed = df.select(F.sha2(F.concat(F.lit(f"{seed}:"), text).cast("binary"), 256).alias("h"), vec_col)
    rows = hashed.mapInArrow(run, "h string, x array<bigint>").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), dim)


def _sums(df: DataFrame, vec_col: str, centroids: np.ndarray, order: np.ndarray) -> list[tuple[int, list[int], int]]:
    """(members, componentwise sums, sum of distances) of each centroid, exact."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = [0] * k, [np.zeros(dim, object) for _ in range(k)], [0] * k
        for batch in batches:
            x = integers(batch.column(0), dim)[1]
            if not len(x):
                continue
            cluster, best = nearest(x, centroids, order)
            for c in range(k):
                mine = np.flatnonzero(cluster == c)
                n[c] += len(mine)
                sums[c] = sums[c] + x[mine].sum(axis=0).astype(object)
                inertia[c] += int(best[mine].astype(object).sum())
        # the place after the last dimension holds the inertia; numbers go as high and low digits, so that sums stay exact
        rows = [(c, d, n[c], v // 10**18, v % 10**18) for c in range(k) if n[c] for d, v in enumerate([*sums[c], inertia[c]])]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)), strict=True)], names=["c", "d", "n", "hi", "lo"])

    found = df.select(vec_col).mapInArrow(run, "c int, d int, n long, hi decimal(38,0), lo decimal(38,0)").groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    out = [[0, [0] * dim, 0] for _ in range(k)]
    for r in found.collect():  # centroids by dimensions
        value = int(r["hi"]) * 10**18 + int(r["lo"])
        out[r["c"]][0] = r["n"]
        if r["d"] < dim:
            out[r["c"]][1][r["d"]] = value
        else:
            out[r["c"]][2] = value
    return [tuple(x) for x in out]


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, dim: int = 64, rounds: int = 10, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, dimensions by falling variance) after the rounds, or when a round changes nothing."""
    order, centroids = _moments(df, vec_col, dim), _first(df, id_col, vec_col, dim, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (n, sums, _) in enumerate(_sums(df, vec_col, centroids, order)):
            if n:
                moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids, order


def assign(df: DataFrame, centroids: np.ndarray, order: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of each vector that takes part."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), dim)
            if len(x) and len(centroids):
                cluster, best = nearest(x, centroids, order)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cluster.astype(np.int32)), pa.array([_long(d) for d in best.tolist()], pa.int64())], names=[id_col, "cluster", "distance"])

    kind = T.StructType([df.schema[id_col], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return df.select(id_col, vec_col).mapInArrow(run, kind)


def report(df: DataFrame, **options) -> DataFrame:
    """Each vector's cluster and distance, with the inertia of its cluster and of all, and a digest of its centroid."""
    centroids, order = fit(df, **options)
    inertia = [d for _, _, d in _sums(df, "embedding", centroids, order)] if len(centroids) else []
    text = [",".join(map(str, c.tolist())) for c in centroids]
    spark = df.sparkSession
    rows = [(c, _long(d), _long(sum(inertia)), t) for c, (d, t) in enumerate(zip(inertia, text, strict=True))]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    named = named.withColumn("centroid_sha256", F.sha2(F.col("components").cast("binary"), 256)).drop("components")
    return assign(df, centroids, order).join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def report_sql(k: int = 8, dim: int = 64, rounds: int = 10, seed: int = 3) -> str:
    """DuckDB SQL for :func:`report` over ``embeddings``."""

    def assigned(i: int) -> str:
        return f"""d{i} AS MATERIALIZED (
  SELECT rid, k, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM v JOIN c{i} c USING (d) GROUP BY rid, k
), a{i} AS MATERIALIZED (
  SELECT rid, k, dist FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, k) AS r FROM d{i}) WHERE r = 1
)"""

    def moved(i: int) -> str:
        floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        return f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, c.d, coalesce({floor}, c.x) AS x FROM c{i} c
  LEFT JOIN (SELECT k, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN v USING (rid) GROUP BY k, d) m USING (k, d)
)"""

    steps = ",\n".join(f"{assigned(i)}, {moved(i)}" for i in range(rounds))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT rid, unnest(range(1, {dim} + 1)) AS d, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e
), c0 AS MATERIALIZED (
  SELECT f.k, v.d, v.x FROM (
    SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM e QUALIFY k < {k}
  ) f JOIN v USING (rid)
),
{steps},
{assigned(rounds)},
digest AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
  CAST(sum(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (rid) JOIN digest USING (k)
"""
