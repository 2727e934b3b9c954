"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding a word does not replay merges.  An Aho-Corasick automaton over the
*reversed* vocabulary reports, for every position of the word, all tokens that
start there, longest first.  The encoder walks left to right and takes the
longest token whose pair with the token before it is compatible: two
neighbouring tokens are compatible if merging their joint text by the merge
list gives exactly these two.  If no token fits, the last token is taken back
and the end it led to is closed, so each position is closed at most once and
the walk is linear in the word.  The result equals the merge procedure.

Decoding copies slices of one byte string that holds all tokens, by an offset
table.

The text is cut into words by the rules of the tokenizer's file: NFC, lower
case by code point, contractions, runs of letters, single digits and runs of
other characters.  Beyond Latin letters the answer depends on the release of
Unicode, so there the file's own normaliser and word splitter are used.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from weftline.llm.common import WHITE, chunks, map_text

#: Entries that a worker keeps of words and chunks it has encoded; further ones are encoded anew each time.
CACHE_CHUNKS, CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS = 250_000, 400_000, 400_000, 48

_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")


def _byte_glyphs() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self._library = Tokenizer.from_file(path)  # for its normaliser and splitter
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        glyphs = _byte_glyphs()
        self._bytes = {g: b for b, g in enumerate(glyphs)}
        # a word is written in 512 symbols: a byte, or 256 more for the byte that ends the word
        symbols = {g: chr(b) for b, g in enumerate(glyphs)} | {g + self.end: chr(256 + b) for b, g in enumerate(glyphs)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[int, int] = {}
        self.size = size
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[a + b]
            symbols[a + b] = symbols[a] + symbols[b]
            self.left[made], self.right[made] = vocab[a], vocab[b]
            self.pairs.setdefault(vocab[a] * size + vocab[b], made)
        self._fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, spelled in symbols.items():
            i = vocab[token]
            if len(spelled) == 1 or self._compatible(self.left[i], self.right[i], i):
                self.automaton.add_word(spelled[::-1], (len(spelled), i))
        self.automaton.make_automaton()
        self._words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        by_id = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            by_id[i] = token.encode()
        self.tokens = OffsetTable(by_id)
        self.numbers = OffsetTable([str(i).encode() for i in range(size)])

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge that comes before ``limit`` joins the ends of two neighbours.

        The neighbours are undone step by step, the later merge first; a merge
        across the border counts only if it would have come before the step that
        is undone.
        """
        while True:
            made = self.pairs.get(a * self.size + b)
            if made is not None and made < limit:
                return False
            # undo the later merge; at equal rank the right one, which the merge procedure makes second
            if a > b:
                undo_left = self.right[a] != a
            else:
                undo_left = self.left[b] == b and self.right[a] != a
            if undo_left:
                limit, a = a, self.right[a]
            elif self.left[b] != b:
                limit, b = b + 1, self.left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a * self.size + b
        got = self._fits.get(key)
        if got is None:
            got = self._compatible(a, b, self.size)
            if len(self._fits) < CACHE_PAIRS:
                self._fits[key] = got
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word, given as UTF-8."""
        n = len(word)
        spelled = word[:-1].decode("latin-1") + chr(256 + word[-1])
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, token in self.automaton.iter(spelled[::-1]):
            starts[n - 1 - at].append(token)  # longest first
        is_open = bytearray(b"\1") * (n + 1)
        fits = self.fits
        out: list[int] = []
        path: list[tuple[int, int]] = []  # (start, place in starts[start]) of the tokens taken
        at = choice = 0
        while at < n:
            options = starts[at]
            while choice < len(options):
                length, token = options[choice]
                if is_open[at + length] and (not out or fits(out[-1], token)):
                    out.append(token)
                    path.append((at, choice))
                    at, choice = at + length, 0
                    break
                choice += 1
            else:
                is_open[at] = 0
                out.pop()
                at, choice = path.pop()
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii() and max(text) > "\u024f":
            split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
            return [bytes([self._bytes[g] for g in w]).decode() for w, _ in split]
        text = unicodedata.normalize("NFC", text)
        low = text.lower() if text.isascii() else "".join([c.lower() for c in text])
        return _WORDS.findall(low)

    def _encode_chunk(self, chunk: str) -> bytes:
        at, out = 0, []
        if self._special is not None and "<" in chunk:
            for m in self._special.finditer(chunk):
                out.append(self._encode_plain(chunk[at : m.start()]))
                out.append(self.special[m[0]].to_bytes(4, "little"))
                at = m.end()
        out.append(self._encode_plain(chunk[at:]))
        return b"".join(out)

    def _encode_plain(self, chunk: str) -> bytes:
        out = []
        for w in self.words(chunk):
            got = self._words.get(w)
            if got is None:
                got = np.array(self.encode_word(w.encode()), "<u4").tobytes()
                if len(self._words) < CACHE_WORDS and len(w) <= CACHE_CHARS:
                    self._words[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text as unsigned 32-bit integers.

        Words and special tokens never reach across white space, so each
        white-space separated chunk is encoded for itself and remembered.
        """
        known, out = self._chunks, []
        for c in chunks(text):
            got = known.get(c)
            if got is None:
                got = self._encode_chunk(c)
                if len(known) < CACHE_CHUNKS and len(c) <= CACHE_CHARS:
                    known[c] = got
            out.append(got)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens in order, joined by one space, as UTF-8: this vocabulary's file names no decoder."""
        return self.tokens.joined(ids)


class OffsetTable:
    """Byte strings by number, each followed by a space, in one array with an offset table."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) + 1 for s in strings], np.int64)
        self.lengths = lengths.astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int32)
        self.data = np.frombuffer(b"".join(s + b" " for s in strings), np.uint8)

    def joined(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        out = []
        for at in range(0, len(ids), block):
            part = ids[at : at + block]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths, dtype=np.int32)
            total = int(ends[-1])
            places = np.arange(total, dtype=np.int32)
            places += np.repeat(self.starts[part] - (ends - lengths), lengths)
            out.append(self.data[places].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row.

    A null or empty text has no ids.  Repeated rows give repeated rows; an empty
    table gives an empty table.  Very long texts are encoded chunk by chunk.
    """
    return map_text(df, id_col, text_col, f"{_typed(df, id_col)}, ids array<int>", lambda: lambda i, t: (i, load(tokenizer).encode(t or "").tolist()))


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of (id, ids); null ids give the empty text."""
    import pyarrow as pa

    out = df.sparkSession.createDataFrame([], f"{_typed(df, id_col)}, text string").schema

    def run(batches):
        table = load(tokenizer)
        for b in batches:
            texts = [table.decode(np.array(x or [], np.uint32)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, out)


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """For each row, its number of tokens and digests of its ids and of their decoding.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256``
    over the decoded text.  Cases as for :func:`encode`; the digest of an empty
    text is that of no bytes.  ``with_ids`` gives the ids themselves, too.
    """

    def make():
        bpe = load(tokenizer)

        def one(i, text):
            ids = bpe.encode(text or "")
            row = i, len(ids), hashlib.sha256(bpe.numbers.joined(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()
            return (*row, ids.astype(np.int32)) if with_ids else row

        return one

    return map_text(df, id_col, text_col, f"{_typed(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)


def _typed(df: DataFrame, col: str) -> str:
    return f"`{col}` {df.schema[col].dataType.simpleString()}"
