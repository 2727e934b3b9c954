"""Audio fingerprints from pitch classes, and alignment of recordings by them.

A recording is a binary column of 8-bit mono PCM.  Overlapping frames are
transformed, the energy of each frequency is added to one of twelve pitch
classes, and the frames are smoothed over time and normalised.  Sixteen filters
compare sums over neighbouring rectangles of this image (frames by pitch
classes), read from its integral image; each filter gives two bits in Gray code,
and the sixteen make one packed 32-bit integer for each place.

Two recordings are aligned by the histogram of the offsets at which they have
equal integers; at the fullest offset the share of unequal bits over the whole
overlap is the bit error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bpe import _typed
from weftline.llm.common import map_text, shared_folder, written

CLASSES, WIDTH = 12, 8


@dataclass(frozen=True)
class Frames:
    """Samples a second, samples of a frame, and from one frame to the next."""

    rate: int
    size: int
    hop: int


#: For audio: a frame tells semitones apart from 100 Hz on.
AUDIO = Frames(11025, 4096, 1365)
#: For texts that stand in for recordings: frames short enough for some thousand bytes.
SHORT = Frames(8000, 128, 32)
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Integers that two recordings have to share at one offset, and the largest bit error of a match.
SHARED, ERROR = 3, 0.35
#: Integers of one task's block of recordings, and of one block of queries.
BLOCK, QUERY_BLOCK = 1_000_000, 4_000_000


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames): every kind at several places, by rule."""
    out = []
    for i in range(16):
        kind = i % 4
        height = (2, 4, 6, 3)[i // 4]
        width = (8, 4, 6, 2)[(i + i // 4) % 4]
        out.append((kind, (5 * i) % (CLASSES - height + 1), height, width))
    return out


FILTERS = _filters()
GRAY = np.array([0, 1, 3, 2], np.uint32)


@cache
def _pitch_classes(frames: Frames) -> np.ndarray:
    """For each frequency of a frame, its pitch class one-hot; those outside 100 Hz to 3800 Hz count nowhere."""
    hertz = np.fft.rfftfreq(frames.size, 1 / frames.rate)
    out = np.zeros((len(hertz), CLASSES))
    for row, f in enumerate(hertz):
        if 100 <= f <= 3800:
            out[row, int(round(12 * np.log2(f / 440.0))) % CLASSES] = 1
    return out


def chroma(pcm: bytes, frames: Frames = AUDIO) -> np.ndarray:
    """Frames by pitch classes, each frame of length 1 or 0; empty if there is less than one frame."""
    samples = np.frombuffer(pcm, np.uint8).astype(np.float64) - 128
    n, hop = (len(samples) - frames.size) // frames.hop + 1, frames.hop
    if n < 1:
        return np.empty((0, CLASSES))
    out = np.empty((n, CLASSES))
    class_of, window, piece = _pitch_classes(frames), np.hamming(frames.size), max(1, (1 << 19) // frames.size)
    for at in range(0, n, piece):  # long recordings in pieces
        some = np.lib.stride_tricks.sliding_window_view(samples, frames.size)[at * hop : (min(n, at + piece) - 1) * hop + 1 : hop]
        out[at : at + piece] = np.abs(np.fft.rfft(some * window)) ** 2 @ class_of
    padded = np.pad(out, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(w * padded[k : k + n] for k, w in enumerate(SMOOTH))
    size = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.divide(smooth, size, out=np.zeros_like(smooth), where=size > 1e-9)


def fingerprint(pcm: bytes, frames: Frames = AUDIO) -> np.ndarray:
    """Packed integers, one for each place where the widest filter fits."""
    image = chroma(pcm, frames)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    np.cumsum(np.cumsum(image, 0), 1, out=total[1:, 1:])

    def area(x: int, y: int, w: int, h: int) -> np.ndarray:
        return total[x + w : x + w + n, y + h] - total[x : x + n, y + h] - total[x + w : x + w + n, y] + total[x : x + n, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # lower against upper classes
            a, b = area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
        elif kind == 1:  # earlier against later frames
            a, b = area(0, y, w // 2, h), area(w // 2, y, w - w // 2, h)
        elif kind == 2:  # the two diagonals of four rectangles
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            b = area(0, y + h // 2, w // 2, h - h // 2) + area(w // 2, y, w - w // 2, h // 2)
        else:  # the middle against both ends
            a, b = area(w // 4, y, w // 2, h), area(0, y, w // 4, h) + area(w // 4 + w // 2, y, w - w // 4 - w // 2, h)
        value = np.log1p(a) - np.log1p(b)
        middle, step = _LEVELS[(kind, y, h, w)]
        level = (value > middle - step).astype(np.int64) + (value > middle) + (value > middle + step)
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def _levels() -> dict[tuple[int, int, int, int], tuple[float, float]]:
    """The middle and the step of each filter's three thresholds.

    The middle is the filter's value over an even image; the step grows with the
    square root of its area, as sums of independent cells do.
    """
    out, even = {}, 1 / np.sqrt(CLASSES)
    for kind, y, h, w in FILTERS:
        if kind == 0:
            a, b = w * (h // 2), w * (h - h // 2)
        elif kind == 1:
            a, b = h * (w // 2), h * (w - w // 2)
        elif kind == 2:
            a = (w // 2) * (h // 2) + (w - w // 2) * (h - h // 2)
            b = w * h - a
        else:
            a, b = h * (w // 2), h * (w - w // 2)
        out[kind, y, h, w] = (float(np.log1p(a * even) - np.log1p(b * even)), 0.5 / float(np.sqrt(w * h)))
    return out


_LEVELS = _levels()


def fingerprints(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", frames: Frames = AUDIO) -> DataFrame:
    """(id, n_frames, fp binary): little-endian unsigned 32-bit integers.

    A null recording and one shorter than the widest filter have an empty
    fingerprint.  Repeated rows are fingerprinted alike.
    """
    raw = df.select(F.col(id_col), F.base64(F.col(media_col)).alias("media"))

    def make():
        import base64

        def one(i, media):
            pcm = base64.b64decode(media or "")
            return i, max(0, (len(pcm) - frames.size) // frames.hop + 1), fingerprint(pcm, frames).astype("<u4").tobytes()

        return one

    return map_text(raw, id_col, "media", f"{_typed(df, id_col)}, n_frames long, fp binary", make)


def align(query: np.ndarray, other: np.ndarray) -> tuple[int, float, int] | None:
    """(offset, bit error, overlap) at the fullest offset, the smallest of equals; None below SHARED common integers."""
    order = np.argsort(query, kind="stable")
    return dict(_align_all(query[order], np.zeros(len(query), np.int64), order, [query], other)).get(0)


def _align_all(ints: np.ndarray, owner: np.ndarray, place: np.ndarray, queries: list[np.ndarray], other: np.ndarray) -> Iterator[tuple[int, tuple[int, float, int]]]:
    """The alignment of one recording with each query that shares enough; ``ints`` are the queries' sorted integers."""
    first, last = np.searchsorted(ints, other, "left"), np.searchsorted(ints, other, "right")
    n = last - first
    total = int(n.sum())
    if total < SHARED:
        return
    ends = np.cumsum(n)
    votes: list[np.ndarray] = []
    at = 0
    while at < len(other):  # common integers have many partners: in pieces
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
        m = n[at:stop]
        hits = np.repeat(first[at:stop] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        offset = np.repeat(np.arange(at, stop), m) - place[hits]
        votes.append(np.stack(np.unique((owner[hits] << 32) + (offset + (1 << 31)), return_counts=True)))
        at = stop
    key, counts = np.concatenate(votes, 1) if len(votes) > 1 else votes[0]
    if len(votes) > 1:
        key, inverse = np.unique(key, return_inverse=True)
        counts = np.bincount(inverse, counts).astype(np.int64)
    of = key >> 32
    best = np.lexsort((key, -counts, of))
    best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])]
    for b in best[counts[best] >= SHARED]:
        q, offset = int(of[b]), int((key[b] & 0xFFFFFFFF) - (1 << 31))
        mine = queries[q]
        low, high = max(0, offset), min(len(other), len(mine) + offset)
        wrong = int(np.bitwise_count(other[low:high] ^ mine[low - offset : high - offset]).sum())
        yield q, (offset, wrong / (32 * (high - low)), high - low)


def _ints(data) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def matches(prints: DataFrame, queries: Column, k: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(id, rank, match_id, match_offset, bit_error, overlap): for each row that ``queries`` holds of, its k best other recordings.

    Best is the smallest bit error, then the longest overlap, then the smallest
    id; only matches of at most ERROR count.  Equal fingerprints are one entry with
    the k + 1 smallest of their ids, which is all that answers can hold.  Queries
    and recordings meet in blocks, each pair of blocks in one task.
    """
    spark, base = prints.sparkSession, shared_folder(prints.sparkSession)
    given = prints.withColumn("asked", F.coalesce(queries, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), "fp", "asked")
    rows = written(given.where(F.col("id").isNotNull() & (F.length("fp") > 0)).withColumn("name", F.md5("fp")), "prints", base)
    place = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    firsts = rows.select("name", "id").distinct().withColumn("at", place).where(F.col("at") <= k + 1)
    ids = firsts.groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = firsts.where(F.col("at") == 1).select("name", "id").join(rows.select("id", "name", "fp").distinct(), ["id", "name"])
    entries = written(one.join(ids, "name").select("name", "ids", "fp"), "entries", base)
    asked = rows.where("asked").select("name").distinct()
    sought = written(entries.join(asked, "name").select("name", "fp"), "sought", base)
    size = lambda d, per: max(1, -(-(d.agg(F.sum(F.length("fp"))).first()[0] or 0) // (4 * per)))
    n_docs, n_queries = size(entries, BLOCK), size(sought, QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("name"), F.lit(n))
    left = sought.withColumn("q", block(n_queries)).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n_docs - 1)))).select("q", F.col("d").cast("long").alias("d"), "name", "fp")
    right = entries.withColumn("d", block(n_docs)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).select(F.col("q").cast("long").alias("q"), "d", "ids", "fp")

    def meet(asking: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[tuple]] = {}
        own = [_ints(x) for x in asking["fp"]]
        if own and len(others):
            flat = np.concatenate(own)
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(own)), [len(x) for x in own])[order]
            start = np.concatenate([np.arange(len(x)) for x in own])[order]
            flat = flat[order]
            for ids, fp in zip(others["ids"], others["fp"], strict=True):
                for q, (offset, error, overlap) in _align_all(flat, owner, start, own, _ints(fp)):
                    if error <= ERROR:
                        held = best.setdefault(q, [])
                        held += [(error, -overlap, int(i), offset) for i in ids]
                        if len(held) > 8 * (k + 1):
                            held.sort()
                            del held[k + 1 :]
        names = asking["name"].tolist()
        out = [(names[q], i, offset, error, -overlap) for q, held in best.items() for error, overlap, i, offset in sorted(held)[: k + 1]]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (object, np.int64, np.int64, np.float64, np.int64)
        return pd.DataFrame({n: pd.Series(list(c), dtype=t) for n, c, t in zip(("name", "match_id", "match_offset", "bit_error", "overlap"), columns, kinds, strict=True)})

    found = left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInPandas(meet, "name string, match_id long, match_offset long, bit_error double, overlap long")
    order = ["bit_error", F.desc("overlap"), "match_id"]
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("at") <= k + 1).drop("at")
    best = written(best, "best", base)
    answers = rows.where("asked").select("id", "name").distinct().join(best, "name").where(F.col("id") != F.col("match_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(id_col), "rank", "match_id", "match_offset", "bit_error", "overlap")


def report(df: DataFrame, queries: Column, id_col: str = "doc_id", media_col: str = "media", frames: Frames = AUDIO) -> DataFrame:
    """One row for each row of ``df``: its fingerprint's length and crc32, and for queries their best match or nulls.

    Rows that repeat an id have the same match; a null id has none.
    """
    prints = written(fingerprints(df, id_col, media_col, frames), "fingerprints")
    best = matches(prints, queries, 1, id_col).select(F.col(id_col).alias("best_id"), "match_id", "match_offset", "bit_error", "overlap")
    lengths = prints.select(F.col(id_col), "n_frames", (F.length("fp") / 4).cast("long").alias("n_codes"), F.crc32("fp").alias("codes_crc32"))
    return lengths.join(best, F.col(id_col) == F.col("best_id"), "left").drop("best_id")
