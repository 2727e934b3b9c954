"""Text quality by logistic regression over hashed word n-grams, learned with follow-the-regularised-leader.

Features are hashed runs of one and two tokens (lower-cased words and runs of
punctuation) and of one to three token shapes (which of upper case, lower case
and digits follow each other), each valued by the square root of its share.

Learning: a bounded sample of labelled rows, chosen by a hash of the id, is
dealt into a fixed number of shards; each shard runs FTRL-proximal over its rows
and the shards' weights are averaged.  Scoring: the sparse dot product of a
text's features with the weights, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import _typed
from weftline.llm.common import id_remainder, map_text
from weftline.llm.hashing import KIND, LOWER, SPACE, grams, run_hashes

BITS = 18
#: Labelled rows that are learned from, about; all if there are fewer.
SAMPLE = 12_000
SHARDS = 8

_SHAPE = bytes(65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 97 if 97 <= c <= 122 or c >= 128 else c for c in range(256))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending feature numbers and their values; number 0 with value 1 is always there."""
    raw = text.encode()
    data, shape = np.frombuffer(raw.translate(LOWER), np.uint8), np.frombuffer(raw.translate(_SHAPE), np.uint8)
    kind = KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    token = kind[starts] != SPACE if len(data) else np.empty(0, bool)
    starts, ends = starts[token], ends[token]
    if not len(starts):
        return np.zeros(1, np.int64), np.ones(1)
    words = run_hashes(data, starts, ends)
    keep = change[:-1].copy()
    keep[1:] |= shape[1:] != shape[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = run_hashes(shape[keep], place[starts], place[ends])
    every = np.concatenate([grams(words, 1, 1), grams(words, 2, 2), grams(shapes, 1, 3), grams(shapes, 2, 4), grams(shapes, 3, 5)])
    found, counts = np.unique((every >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    some = found > 0
    return np.concatenate([[0], found[some]]), np.concatenate([[1.0], np.sqrt(counts[some] / counts.sum())])


class Ftrl:
    """FTRL-proximal for logistic loss with per-coordinate rates."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sampled(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """The rows whose hashed id falls below the share that leaves about ``bound`` rows; all rows if there are fewer."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * bound / total))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, shards: int = SHARDS, epochs: int = 2) -> np.ndarray:
    """Weights from rows of (id, text, label 0/1).

    Rows without a label are left out; a null text is the empty text.  Without
    any row all weights are 0.  What comes to the driver is one weight vector of
    2**18 numbers for each shard.
    """
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label"))
    rows = sampled(rows, "id", sample).withColumn("order", F.xxhash64(F.lit(12), "id", "text")).withColumn("shard", F.pmod(F.xxhash64(F.lit(13), "id", "text"), F.lit(shards)))
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "order")

    def learn(shard: int, kept: list[tuple]) -> pd.DataFrame:
        model = Ftrl(1 << BITS)
        for _ in range(epochs):
            for at, x, label in kept:
                model.update(at, x, label)
        return pd.DataFrame({"shard": [shard], "n": [len(kept)], "weights": [model.weights().astype("<f4").tobytes()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, kept = None, []
        for frame in frames:
            for of, text, label in zip(frame["shard"], frame["text"], frame["label"], strict=True):
                if of != shard:
                    if kept:
                        yield learn(shard, kept)
                    shard, kept = of, []
                at, x = features(text)
                kept.append((at.astype(np.int32), x.astype(np.float32), label))
        if kept:
            yield learn(shard, kept)

    made = dealt.select("shard", "text", "label").mapInPandas(run, "shard long, n long, weights binary").collect()
    if not made:
        return np.zeros(1 << BITS, np.float32)
    made.sort(key=lambda r: r["shard"])
    return np.average([np.frombuffer(r["weights"], "<f4") for r in made], axis=0, weights=[r["n"] for r in made]).astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row.

    A null text is scored as the empty text, by the bias alone.  Texts are read
    whole; repeated rows are scored alike.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 1 MB whatever the input

    def make():
        w = shared.value

        def one(i, text):
            at, x = features(text or "")
            p = float(1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35))))
            return i, p, int(p >= threshold)

        return one

    return map_text(df, id_col, text_col, f"{_typed(df, id_col)}, score double, predicted int", make)


def held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 4) == 2


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learn from the labels of rows that are not held out and score all rows.

    Returns (id, held_out, score, predicted).  Several labels of one id count by
    their mean; ids without a row are ignored, as are null ids.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("known_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("known_label"))
    labelled = df.select(F.col(id_col), F.col(text_col)).join(known, F.col(id_col) == F.col("known_id"))
    weights = fit(labelled.select(F.col(id_col), F.col(text_col), "known_label"), id_col, text_col, "known_label")
    return score(df, weights, id_col=id_col, text_col=text_col).select(F.col(id_col), held_out(id_col).alias("held_out"), "score", "predicted")
