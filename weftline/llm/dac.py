"""Token ids in directly addressable codes, written as ordered segments and read back.

Each id is split into chunks of fixed width, low bits first.  Level 1 holds the
first chunk of every id; a bitmap says which ids go on, and level 2 holds the
second chunk of those, and so on.  A rank directory (set bits before each 512-bit
block) leads from a place in one level to its place in the next, so any id is
found with one look into each level and no block is decoded.

A dataset is a Parquet table of segments, in Spark's own files and with its
commit protocol, so it can lie in any store and survives lost executors.  A
segment holds the ids of consecutive documents in ascending id order and closes
once it has ``segment_tokens`` ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm.common import ascii_words, shared_folder

MAGIC = b"DAC1"
RANK_BITS = 512
WIDTHS = (8, 8, 16)

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The codes of ids below 2**32; every width is 8 or 16, and they add up to 32."""
    if sum(widths) != 32 or any(w not in (8, 16) for w in widths):
        raise ValueError("widths are 8 or 16 and add up to 32")
    rest = np.asarray(ids, np.uint32)
    out = [MAGIC, bytes([len(widths), *widths])]
    for level, width in enumerate(widths):
        low = (rest & np.uint32((1 << width) - 1)).astype("<u1" if width == 8 else "<u2")
        out += [len(rest).to_bytes(8, "little"), low.tobytes()]
        if level + 1 < len(widths):
            more = (rest >> np.uint32(width)) > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
            counts = _POP[bits].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
            directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
            out += [bits.tobytes(), directory.tobytes()]
            rest = rest[more] >> np.uint32(width)
    return b"".join(out)


class Codes:
    """Reads packed codes in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not directly addressable codes")
        self.widths = tuple(data[5 : 5 + data[4]])
        at, self.levels = 5 + data[4], []
        for level, width in enumerate(self.widths):
            n = int.from_bytes(data[at : at + 8], "little")
            at += 8
            low = np.frombuffer(data, "<u1" if width == 8 else "<u2", n, at)
            at += low.nbytes
            bits = directory = None
            if level + 1 < len(self.widths):
                size = -(-n // RANK_BITS) * (RANK_BITS // 8)
                bits = np.frombuffer(data, np.uint8, size, at)
                directory = np.frombuffer(data, "<u4", n and size * 8 // RANK_BITS + 1 or 1, at + size)
                at += size + directory.nbytes
            self.levels.append((low, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at one place, by rank, without decoding others."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for (low, bits, directory), width in zip(self.levels, self.widths, strict=True):
            value |= int(low[i]) << shift
            shift += width
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            whole = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(directory[block]) + int(_POP[whole].sum()) + int(_POP[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level from the last."""
        above: np.ndarray | None = None
        for (low, bits, _), width in zip(reversed(self.levels), reversed(self.widths), strict=True):
            ids = low.astype(np.uint32)
            if bits is not None:
                more = np.unpackbits(bits, count=len(ids), bitorder="little").astype(bool)
                ids[more] |= above << np.uint32(width)
            above = ids
        return above


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` numbered by ``at``, one after the other, and where each ends."""
    counts = sizes[at]
    ends = np.cumsum(counts)
    places = np.repeat(starts[at] - (ends - counts), counts)
    places += np.arange(len(places))
    return flat[places], ends


class LibraryEncoder:
    """Whole texts through the tokenizers library, each distinct word once.

    Words never reach across white space, so a text's ids are those of its chunks
    between ASCII white space, in order.  A chunk of plain Latin letters, digits
    and punctuation is cut further where the tokenizer cuts it.  A batch has each of its
    different chunks, and of these each different piece, once in Arrow's dictionaries; pieces that are new go
    through the library together, with a special token between them to part the result.
    """

    PIECES, CHARS = 400_000, 48
    _PLAIN = r"^[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=-@\[-`{-~]+$"
    _PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+|\n")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        special = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.mark_id, self.mark = next(iter(special.items()))
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        words, offsets = ascii_words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pc.dictionary_encode(words)
        ids, ends = _gathered(*self._chunks(coded.dictionary), coded.indices.to_numpy())
        return ids, np.diff(np.concatenate([[0], ends])[offsets])

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks: all of them, where each chunk's begin, and how many they are."""
        is_plain = pc.match_substring_regex(chunks, self._PLAIN)
        plain, other = chunks.filter(is_plain), chunks.filter(pc.invert(is_plain))
        lines = pc.binary_join(pa.LargeListArray.from_arrays([0, len(plain)], plain), pa.scalar("\n", pa.large_string()))[0].as_py()
        parts = self._PIECES.findall(lines.lower())
        cut = pa.array(parts, pa.large_string())
        line = pc.equal(cut, "\n").to_numpy(zero_copy_only=False)
        owner = np.concatenate([np.cumsum(line)[~line], np.arange(len(other)) + len(plain)])
        coded = pc.dictionary_encode(pa.concat_arrays([cut.filter(pa.array(~line)), other.cast(pa.large_string())]))
        made = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        at = coded.indices.to_numpy()
        flat, _ = _gathered(np.frombuffer(b"".join(made), "<u4"), np.cumsum(sizes) - sizes, sizes, at)
        counts = np.bincount(owner, sizes[at], len(chunks)).astype(np.int64)
        order = np.argsort(~is_plain.to_numpy(zero_copy_only=False), kind="stable")  # plain chunks first, as they were cut
        starts, own = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        starts[order], own[order] = np.cumsum(counts) - counts, counts
        return flat, starts, own

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Each piece's ids as bytes; those that are short are remembered."""
        made = list(map(self.pieces.get, parts))
        through = self._through([p for p, ids in zip(parts, made, strict=True) if ids is None])
        if len(self.pieces) < self.PIECES:
            self.pieces |= {p: ids for p, ids in through.items() if len(p) <= self.CHARS}
        return [through[p] if ids is None else ids for p, ids in zip(parts, made, strict=True)]

    def _through(self, fresh: list[str]) -> dict[str, bytes]:
        plain = [c for c in fresh if "<|" not in c]
        made = {c: np.array(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in fresh if "<|" in c}
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            (joined,) = self.library.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)
            ids = np.array(joined.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            start = 0
            for c, end in zip(part, ends, strict=True):
                made[c] = ids[start:end].tobytes()
                start = end + 1
        return made


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


#: Texts whose words are looked up together.
BATCH = 4096
STARTS = "part long, segment long, n_tokens long, start long"
SEGMENT = "part long, segment long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, segment_tokens: int = 1 << 18) -> None:
    """Encode every text, append ``end_id``, and write segments in ascending id order.

    A null or empty text gives the end id alone.  Rows with equal ids follow each
    other, ordered by their texts' hashes; a null id comes first.  An empty table
    gives an empty dataset.  A document is never split, so a segment is at most
    one document longer than ``segment_tokens``.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part, segment = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            data = np.concatenate(held)
            row = {"part": part, "segment": segment, "n_tokens": len(data), "doc_ids": ids, "doc_tokens": counts, "codes": pack(data)}
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                tokens, n = encoder.encode(piece.column(1))
                start = 0
                for i, count in zip(piece.column(0).to_pylist(), n.tolist(), strict=True):
                    ids.append(i)
                    counts.append(count + 1)
                    held += [tokens[start : start + count], end]
                    start += count
                    size += count + 1
                    if size >= segment_tokens:
                        yield close()
                        ids, counts, held, size, segment = [], [], [], 0, segment + 1
        if ids:
            yield close()

    end = np.array([end_id], np.uint32)
    schema = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("codes", pa.binary())])
    ordered.select("id", "text").mapInArrow(run, SEGMENT).write.parquet(path)
    _starts(df.sparkSession, path).write.parquet(f"{path}.starts")


def _starts(spark, path: str) -> DataFrame:
    """(part, segment, n_tokens, start) of each segment, in order; sums by part need one row for each written file."""
    own = spark.read.schema(SEGMENT).parquet(path).select("part", "segment", "n_tokens")
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    starts = own.withColumn("inside", inside).join(parts, "part").select("part", "segment", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartitionByRange(n, "start").sortWithinPartitions("start")


def read(spark, path: str) -> DataFrame:
    """The dataset's segments, each with ``start``: how many ids come before it, from the table that was written with them."""
    starts = spark.read.schema(STARTS).parquet(f"{path}.starts").select("part", "segment", "start")
    return spark.read.schema(SEGMENT).parquet(path).join(starts, ["part", "segment"])


def documents(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the codes on disk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, s in frame.iterrows():
                ids = Codes(s["codes"]).all().astype("<u4")
                ends = np.cumsum(np.asarray(s["doc_tokens"], np.int64))
                starts = ends - s["doc_tokens"]
                yield pd.DataFrame(
                    {
                        id_col: pd.array([None if pd.isna(i) else int(i) for i in s["doc_ids"]], "Int64"),
                        "start": starts + s["start"],
                        "n_tokens": ends - starts,
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    segments = read(spark, path).select("start", F.transform("doc_ids", lambda i: i.cast("string")).alias("doc_ids"), "doc_tokens", "codes")
    return segments.mapInPandas(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_at(spark, path: str, position: int) -> int | None:
    """The id at one place of the whole dataset: one row of the table of starts, then that segment's row alone, both found by filters that reach the files."""
    starts = spark.read.schema(STARTS).parquet(f"{path}.starts")
    at = starts.where((F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position)).head(1)
    if not at:
        return None
    part, segment, _, start = at[0]
    codes = spark.read.schema(SEGMENT).parquet(path).where((F.col("part") == part) & (F.col("segment") == segment)).select("codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Codes(c.as_py())[position - start] for c in batch.column(0)], pa.int64())], names=["id"])

    return codes.mapInArrow(run, "id long").first()[0]


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the codes of all texts to the shared folder and list the documents from the files."""
    path = f"{shared_folder(df.sparkSession)}/codes"
    write(df, path, tokenizer, end_id)
    return documents(df.sparkSession, path)
