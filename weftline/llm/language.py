"""Language identification by rank-order profiles of letter n-grams.

A profile lists the most frequent n-grams (one to three letters; words padded
with a blank) in order.  A text is ranked in the same way, and its distance to a
language is the sum, over its n-grams, of how far each lies out of place in the
language's profile; an n-gram that is not in the profile counts as the length of
a profile.  The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import _typed
from weftline.llm.common import SLICE, id_remainder, map_text

PROFILE = 400
#: Learned from about so many rows of each language, chosen by a hash of the id; all if there are fewer.
SAMPLE = 2_000
#: More languages than this are refused: profiles go to every task.
MOST_LANGUAGES = 2_000

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed into 63 bits, and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes[~_is_letter()[codes]] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    c = codes[keep]  # letters, and one 0 between words
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    shift, first = np.uint64(21), np.uint64(1) << np.uint64(20)
    two = (c[:-1] | first) << shift | c[1:]
    inner = c[1:-1] != 0
    three = ((two[:-1] << shift) | c[2:])[inner]
    return np.unique(np.concatenate([c[c != 0], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, length: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams first; ties in order of the n-grams."""
    if len(grams) > length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))[:length]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], length: int = PROFILE):
        self.names = sorted(profiles)
        self.length = length
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.uint64)
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, np.int32)
        for row, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(profiles[name], np.uint64))
            self.rank[row, at] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*gram_counts(text or ""), self.length)
        if not len(mine) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.grams, mine)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != mine] = len(self.grams)
        theirs = self.rank[:, at]
        far = np.where(theirs < 0, self.length, np.abs(theirs - np.arange(len(mine), dtype=np.int32))).sum(1)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (self.length * len(mine))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, length: int = PROFILE) -> dict[str, list[int]]:
    """A profile for each language of the rows that have one and a text.

    N-grams are counted where the rows lie and summed by language and n-gram;
    only the profiles come to the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, 1_000_000 * sample // n + 1))])
    lang = F.col(lang_col).cast("string")
    some = rows.where(F.pmod(F.xxhash64(F.lit(21), F.col(id_col)), F.lit(1_000_000)) < share[lang])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, dict[int, int]] = {}
        for frame in frames:
            for name, text in zip(frame["lang"], frame["text"], strict=True):
                into = sums.setdefault(name, {})
                grams, counts = gram_counts(text)
                for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                    into[g] = into.get(g, 0) + n
        for name, into in sums.items():
            yield pd.DataFrame({"lang": pd.Series([name] * len(into), dtype=object), "gram": list(into), "n": list(into.values())})

    counted = some.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).mapInPandas(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("at") <= length)
    profiles: dict[str, list[int]] = {name: [] for name in sizes}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["at"])):
        profiles[r["lang"]].append(r["gram"])
    return profiles


def predict(df: DataFrame, profiles: dict[str, list[int]], length: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if nothing was learned.  The score is 1 less the distance's share of the
    largest possible distance; ties go to the first name.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # at most MOST_LANGUAGES x length numbers

    def make():
        model = Profiles(shared.value, length)
        return lambda i, text: (i, *model.predict(text))

    return map_text(df, id_col, text_col, f"{_typed(df, id_col)}, lang_pred string, score double", make)


def predict_rows(df: DataFrame, profiles: dict[str, list[int]], length: int = PROFILE, text_col: str = "text", into: str = "lang_pred") -> DataFrame:
    """All columns of ``df`` and the prediction in the column ``into``, by the same rules as :func:`predict`.

    Rows go through as the Arrow columns they are; only some texts at a time are Python objects.
    """
    if into in df.columns:
        raise ValueError(f"there is a column {into}")
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    texts = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(shared.value, length)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [model.predict(text)[0] for text in part.column(texts).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 3) == 1


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict all: (id, held_out, lang_pred, score)."""
    profiles = fit(df.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(df, profiles, id_col=id_col, text_col=text_col).select(F.col(id_col), held_out(id_col).alias("held_out"), "lang_pred", "score")
