"""Periodic runs of words: Kolpakov-Kucherov over an LZ factorisation.

A run is a stretch of consecutive words with smallest period q that is at least
``max(least, 2 * q)`` long and that no neighbouring word extends with that period.

Stretches that can hold a run are found first, over a whole batch of texts at a
time: every word of a run lies in a window of ``least // 2`` words that occurs
again in the same stretch, so words outside such windows part a text.  Within a
stretch the runs come from its LZ factorisation, made with a suffix automaton:
Main's algorithm gives those that touch the border of two factors, and the others
are copies of runs within a factor's earlier occurrence.

Defined cases: a null text has no words and no runs; a text without runs is
collapsed to its words, joined by one space; repeated ids and texts are rows of
their own; the order of runs is by start, then period.  A stretch's automaton takes some 0.5 KB of its task for each word of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ascii_words, fresh

#: About so many bytes of text are worked on at a time.
PART = 4 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


# --- the runs of one sequence -------------------------------------------------------------------------


def _factors(w: Sequence[int]) -> list[tuple[int, int, int]]:
    """LZ factors as (start, length, earlier occurrence or -1), by the suffix automaton of ``w``."""
    edges: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 != length[q]:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = q = twin
            link[new] = q
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        at, size = 0, 0
        while i + size < n:
            to = edges[at][w[i + size]]
            if first[to] >= i + size:  # it has not occurred before
                break
            at, size = to, size + 1
        out.append((i, size, first[at] - size + 1) if size else (i, 1, -1))
        i += max(size, 1)
    return out


def _prefixes(s: Sequence[int]) -> list[int]:
    """For each place, how far the sequence from there on agrees with the sequence itself."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def find(w: Sequence[int], least: int = 12) -> list[tuple[int, int, int]]:
    """All runs of ``w`` as (start, length, period), by start, then period."""
    n = len(w)
    if not n:
        return []
    factors = _factors(w)
    found: list[dict[int, int]] = [{} for _ in range(n)]  # by start: the end's smallest period

    def keep(start: int, end: int, q: int) -> None:
        if end - start >= max(least, 2 * q):
            found[start][end] = min(q, found[start].get(end, q))

    for (before, left, _), (b, right, source) in zip(factors, [*factors[1:], (n, 0, -1)], strict=True):
        if source < 0:  # nothing goes past a new word; what ends here lies within the factor before it
            if left < least:
                continue
            lo, hi, reach = before, b, left // 2
        else:
            lo, hi, reach = max(0, b - 2 * left - right), min(n, b + right + 1), min(b, left + right - 1)
        # runs reach less far than the window, except where the sequence itself ends
        inner = lo if lo == 0 and (source >= 0 or before == 0) else lo + 1
        outer = hi if hi == n and hi <= b + right else hi - (source >= 0)
        x, v = w[lo:b], w[b:hi]
        back = _prefixes(x[::-1])
        ahead = _prefixes([*v, -1, *x[-reach:], *v]) if v and reach else []
        for q in range(1, reach + 1):  # a period that lies left of the border
            suffix = back[q] if q < len(back) else 0
            prefix = ahead[len(v) + 1 + min(reach, len(x)) - q] if ahead else 0
            start, end = b - q - suffix, b + prefix
            if suffix + prefix >= q and start >= inner and end <= outer:
                keep(start, end, q)
        if source < 0:
            continue
        own = _prefixes(v)
        near = w[max(0, b - right) : b][::-1]
        joined = _prefixes([*near, -1, *v[::-1], *near])
        for q in range(1, right + 1):  # a period that lies right of it
            prefix = own[q] if q < len(v) else 0
            suffix = joined[len(near) + 1 + len(v) - q]
            start, end = b - suffix, b + q + prefix
            if q <= len(v) and suffix < q <= suffix + prefix and start >= inner and end <= outer:
                keep(start, end, q)
    for b, size, source in factors:
        if source >= 0:
            for start in range(source + 1, source + size - least):
                for end, q in found[start].items():
                    if end < source + size:
                        keep(start + b - source, end + b - source, q)
    return sorted((s, e - s, q) for s, ends in enumerate(found) for e, q in ends.items())


# --- stretches of a batch -------------------------------------------------------------------------------


def _repeated(codes: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that occurs again in its group; one more now and then does no harm."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(len(codes), bool)
    h = group[:n].astype(np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(group[:n] == group[width - 1 :])
    low = (h[at] & np.uint64((1 << 20) - 1)).astype(np.int64)
    at = at[np.bincount(low, minlength=1 << 20)[low] > 1]
    _, back, count = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return np.cumsum(steps[:-1]) > 0


def stretches(codes: np.ndarray, group: np.ndarray, least: int = 12) -> list[tuple[int, int]]:
    """(start, end) of the stretches, each within one group, that hold every run."""
    places = np.arange(len(codes))
    while len(places):
        hit = _repeated(codes[places], group, least // 2)
        kept = places[hit]
        # a new group begins with each stretch
        begins = np.ones(len(kept), bool)
        begins[1:] = (np.diff(kept) > 1) | (np.diff(group[hit]) != 0)
        stretch = np.cumsum(begins)
        size = np.bincount(stretch, minlength=1)[stretch] if len(kept) else np.zeros(0, int)
        done = len(kept) == len(places)
        places, group = kept[size >= least], stretch[size >= least]
        if done and len(places) == len(kept):
            break
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(places) else []
    return [(int(places[i]), int(places[j - 1]) + 1) for i, j in zip(edges[:-1], edges[1:], strict=True)]


# --- texts -----------------------------------------------------------------------------------------------


def _part(ids: list, texts: pa.Array, rewrite: Callable[[object, int], tuple[int, int] | None] | None, least: int) -> tuple[list, pa.Array, np.ndarray]:
    words, offsets = ascii_words(texts)
    sizes = np.diff(offsets)
    place = np.arange(len(words))
    if rewrite is not None:
        for i, (key, n) in enumerate(zip(ids, sizes.tolist(), strict=True)):
            if (made := rewrite(key, n)) is not None:
                start, period = offsets[i] + made[0], made[1]
                place[start : offsets[i + 1]] = start + np.arange(offsets[i + 1] - start) % period
    encoded = pc.dictionary_encode(words)
    codes = encoded.indices.to_numpy()[place] if len(words) else np.zeros(0, np.int32)
    group = np.repeat(np.arange(len(ids)), sizes)
    keep = np.ones(len(words), bool)
    runs: list[list[dict]] = [[] for _ in ids]
    for start, end in stretches(codes, group, least):
        i = int(group[start])
        for s, length, q in find(codes[start:end].tolist(), least):
            s += start
            keep[s + q : s + length] = False
            runs[i].append({"start": int(s - offsets[i]), "length": length, "period": q})
    left = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.take(pa.array(place[keep])))
    return runs, pc.binary_join(kept, pa.scalar(" ", pa.large_string())), sizes


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, rewrite: Callable[[object, int], tuple[int, int] | None] | None = None, into: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """The id of each row with its number of words, its runs, and its text without repeats.

    The collapsed text leaves out each run's words after its first period.
    ``rewrite`` may say, of an id and a number of words, (place, period): from that
    place on the words then repeat with that period before runs are looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART, side="right")))
                part = batch.slice(at, end - at)
                runs, collapsed, n = _part(part.column(0).to_pylist(), part.column(1), rewrite, least)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(runs, kinds[2]), collapsed.cast(kinds[3])]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)
                at = end

    from pyspark.sql.pandas.types import to_arrow_schema

    (key,) = fresh(df.select(*[F.lit(0).alias(c) for c in into]), id_col)
    rows = df.select(F.col(id_col).alias(key), F.col(text_col).cast("string").alias("__text"))
    out = rows.select(F.col(key), F.lit(0).cast("long").alias(into[0]), F.lit(None).cast(RUNS).alias(into[1]), F.lit("").alias(into[2])).schema
    names, kinds = out.names, to_arrow_schema(out).types
    return rows.mapInArrow(run, out)


def planted(doc_id: object, n: int) -> tuple[int, int] | None:
    """The periods that the query plants: one document in ten repeats from a place on, by the checksum of its id."""
    from zlib import crc32

    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def report(df: DataFrame, rewrite: Callable[[object, int], tuple[int, int] | None] | None = planted) -> DataFrame:
    """Of each document: how many runs, the longest one, and digests of all runs and of the collapsed text."""
    found = annotate(df, rewrite=rewrite)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div (-best.period)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
