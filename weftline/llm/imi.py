"""Nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids; a vector lies
in the cell of its two nearest centroids.  A search orders the centroids of each
half by their distance to the query's half and walks the pairs by summed distance
with a heap, until the cells it has met hold enough vectors.  The entries of these
cells are then ranked by their exact distance to the query.

Centroids are fitted on a bounded sample; all vectors are indexed.  Equal vectors
are one entry that carries the smallest of their ids, one more than a search
returns; further copies can never be among the answers, so nothing is lost.
Cells in order of their numbers make blocks of about equal size; a large cell is
dealt over several.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import shared_folder, written

#: The centroids are fitted on about so many distinct vectors; all if there are fewer.
SAMPLE = 20_000
#: A search meets the share of all vectors that held so much of the true neighbours of :data:`TRIED` vectors in the
#: sample: clustered vectors need a small share, vectors without any structure need most.
RECALL, TRIED = 0.97, 100
#: Entries of one task's block.
BLOCK = 4_000


def centroid_count(n: int) -> int:
    """Centroids of each half for n distinct vectors: cells grow in number as the square root of n."""
    return int(max(1, min(512, round(4 * n**0.25))))


def kmeans(points: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced points along the first direction of spread; same input, same centroids."""
    k = min(k, len(points))
    middle = points - points.mean(0)
    along = middle @ np.linalg.svd(middle[:2000], full_matrices=False)[2][0] if len(points) > 1 else np.zeros(len(points))
    order = np.argsort(along, kind="stable")
    centres = points[order[np.linspace(0, len(points) - 1, k).astype(int)]].copy()
    for _ in range(turns):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)


def cells_in_order(left: np.ndarray, right: np.ndarray, counts: np.ndarray, reach: int) -> list[int]:
    """Cells by summed distance, walked with a heap, until they hold ``reach`` vectors."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, pushed = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    out, held = [], 0
    while heap and held < reach:
        _, i, j = heapq.heappop(heap)
        n = counts[a[i], b[j]]
        if n:
            out.append(int(a[i]) * len(right) + int(b[j]))
            held += int(n)
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(left) and y < len(right) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return out


def fitted_share(points: np.ndarray, both: list[np.ndarray], half: int, k: int) -> float:
    """The share of the sample that a search has to meet for RECALL of the true neighbours.

    Every vector tried is searched for among the others of the sample, as all vectors will be
    among all; there its neighbours are nearer, in cells that are met no later.
    """
    if len(points) <= k + 1:
        return 1.0
    cell = nearest(points[:, :half], both[0]) * len(both[1]) + nearest(points[:, half:], both[1])
    counts = np.bincount(cell, minlength=len(both[0]) * len(both[1]))
    needed = []
    for q in np.linspace(0, len(points) - 1, min(TRIED, len(points))).astype(int):
        x = points[q]
        far = ((points - x) ** 2).sum(1)
        far[q] = np.inf
        sums = ((both[0] - x[:half]) ** 2).sum(1)[:, None] + ((both[1] - x[half:]) ** 2).sum(1)[None]
        order = np.argsort(sums, axis=None, kind="stable")
        met = np.empty(len(order))
        met[order] = np.cumsum(counts[order])
        needed += met[cell[np.argpartition(far, k)[:k]]].tolist()
    return float(np.quantile(needed, RECALL)) / len(points)


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(wide, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _objects(strings) -> pd.Series:
    """Strings as plain objects: pandas' own string columns may come in chunks, which Spark's conversion refuses."""
    return pd.Series(list(strings), dtype=object)


def search(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` holds of, its k nearest other rows.

    The score is the Euclidean distance in double precision; ties go to the
    smaller id.  Vectors that are null, empty or zero, hold null or non-finite
    components, or differ in length from the most frequent length, take no part, as do
    null ids.  ``share`` is how much of the table a search meets; fitted, if it is not given.
    Repeated ids with equal vectors are one row.  Fewer than k other
    rows give all of them; an empty table gives no rows.
    """
    spark, base = df.sparkSession, shared_folder(df.sparkSession)
    given = df.withColumn("imi_query", F.coalesce(queries, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), "imi_query")
    rows = given.where(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    dims = lengths[0]["d"]
    rows = rows.where(F.size("vector") == dims).withColumn("name", F.md5(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))))
    rows = written(rows.dropDuplicates(["id", "name"]), "rows", base)

    # the k + 1 smallest ids of each distinct vector; Spark limits them before the shuffle too
    place = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    firsts = rows.select("name", "id").withColumn("at", place).where(F.col("at") <= k + 1)
    ids = firsts.groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = written(firsts.where(F.col("at") == 1).select("id").join(rows, "id").join(ids, "name").select("name", "ids", "vector"), "entries", base)
    total = entries.count()
    part = min(1.0, sample / total)
    taken = entries if part == 1 else entries.where(F.pmod(F.xxhash64("name"), F.lit(1_000_000)) < int(part * 1_000_000))
    points = _matrix(taken.select("vector").limit(2 * sample).toPandas()["vector"])
    points = points[np.lexsort(points.T[::-1])]
    half = max(1, dims // 2)
    number = centroid_count(total)
    both = [kmeans(points[:, :half], number), kmeans(points[:, half:], number) if dims > half else np.zeros((1, 0))]
    share = fitted_share(points[:: max(1, len(points) // sample)], both, half, k) if share is None else share
    reach = max(k + 1, int(np.ceil(share * total)))
    shared = spark.sparkContext.broadcast(both)  # at most 2 x 512 centroids

    def place_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = shared.value
        for f in frames:
            x = _matrix(f["vector"])
            yield f.assign(name=_objects(f["name"]), cell=nearest(x[:, :half], left) * len(right) + nearest(x[:, half:], right))

    indexed = written(entries.mapInPandas(place_all, "name string, ids array<long>, vector array<double>, cell long"), "indexed", base)
    held = indexed.groupBy("cell").count()
    counts = np.zeros((len(both[0]), len(both[1])), np.int64)
    for cell, n in held.collect():  # at most one row for each of 512 x 512 cells
        counts[divmod(cell, len(both[1]))] = n
    ends = np.cumsum(counts)
    first, last = (ends - counts.ravel()) // BLOCK, np.maximum(ends - 1, 0) // BLOCK  # the blocks of each cell
    sizes = spark.sparkContext.broadcast((counts, first, last))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, first, last = sizes.value
        for f in frames:
            number = np.array([int(x[:12], 16) for x in f["name"]], np.int64)
            cell = f["cell"].to_numpy()
            yield f[["ids", "vector", "cell"]].assign(block=first[cell] + number % (last[cell] - first[cell] + 1))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = shared.value
        counts, first, last = sizes.value
        for f in frames:
            x = _matrix(f["vector"])
            for row in range(len(f)):
                a, b = ((left - x[row, :half]) ** 2).sum(1), ((right - x[row, half:]) ** 2).sum(1)
                by_block: dict[int, list[int]] = {}
                for c in cells_in_order(a, b, counts, reach):
                    for block in range(first[c], last[c] + 1):
                        by_block.setdefault(block, []).append(c)
                yield pd.DataFrame({"query": _objects([f["query"].iloc[row]] * len(by_block)), "vector": [f["vector"].iloc[row]] * len(by_block), "block": list(by_block), "cells": list(by_block.values())})

    asked = rows.where("imi_query").select("name").distinct().join(indexed, "name").select(F.col("name").alias("query"), "vector")
    visits = asked.repartition(F.col("query")).mapInPandas(visit, "query string, vector array<double>, block long, cells array<long>")
    dealt = indexed.mapInPandas(deal, "ids array<long>, vector array<double>, cell long, block long")

    def rerank(asking: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        found = [(), (), ()]
        if len(asking) and len(entries):
            y, cell = _matrix(entries["vector"]), entries["cell"].to_numpy()
            ids = entries["ids"].tolist()
            smallest = np.array([i[0] for i in ids])
            rows = []
            for q, v, cells in zip(asking["query"], _matrix(asking["vector"]), asking["cells"], strict=True):
                some = np.flatnonzero(np.isin(cell, cells))
                score = np.sqrt(((y[some] - v) ** 2).sum(1))
                if len(some) > k + 1:
                    near = score <= np.partition(score, k)[k]
                    some, score = some[near], score[near]
                for e in np.lexsort((smallest[some], score))[: k + 1]:
                    rows += [(q, int(i), float(score[e])) for i in ids[some[e]]]
            found = list(zip(*rows, strict=True)) or found
        return pd.DataFrame({"query": _objects(found[0]), "id": np.array(found[1], np.int64), "score": np.array(found[2], np.float64)})

    near = visits.groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(rerank, "query string, id long, score double")
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("at") <= k + 1)
    best = written(best.select("query", "id", "score"), "best", base)
    own = rows.where("imi_query").select(F.col("id").alias("query_id"), F.col("name").alias("query"))
    answers = own.join(best, "query").where(F.col("id") != F.col("query_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
