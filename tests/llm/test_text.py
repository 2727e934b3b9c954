"""Licences, codes, BPE, quality, language: against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bpe, chroma, dac, language, licences, quality
from weftline.llm.hashing import shingles, weighted_jaccard, word_hashes
from weftline.llm.queries import tokenizer_path

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
EDGES = [(1, None), (2, ""), (3, "Under the MIT License."), (3, "Under the MIT License."), (None, "x"), (4, "word " * 30000), (5, "\n\t "), (6, "###")]


def edge_table(spark):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in EDGES], "doc_id long, text string, n_tokens long, score string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="abeinrst' <|>12.,!?éßΣ́\x1c\x85　", max_size=40))
def test_bpe_is_the_library(text):
    mine = bpe.load(PATH)
    ids = mine.encode(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert mine.decode(ids).decode() == LIBRARY.decode(want, skip_special_tokens=False)
    assert [x.tolist() for x in dac._encoder(PATH).encode(pa.array([text, None, text]))] == [want * 2, [len(want), 0, len(want)]]


def test_bpe_special_tokens():
    text = "a<|endoftext|>B <|startoftext|>'s"
    assert bpe.load(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_table(spark):
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.digests(edge_table(spark), PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1, 0]["ids_sha256"] == got[2, 0]["decoded_sha256"] == empty
    word = str(LIBRARY.encode("word", add_special_tokens=False).ids[0])
    assert got[4, 30000]["ids_sha256"] == hashlib.sha256(" ".join([word] * 30000).encode()).hexdigest()
    encoded = bpe.encode(edge_table(spark), PATH)
    assert encoded.count() == len(EDGES)
    text = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()}
    assert text[3].startswith("under</w> the</w>")
    assert bpe.digests(edge_table(spark).limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.sampled_from([(8, 8, 16), (8, 8, 8, 8), (16, 16)]))
def test_codes_round_trip(ids, widths):
    codes = dac.Codes(dac.pack(np.array(ids, np.uint32), widths))
    assert codes.all().tolist() == ids
    for i in range(0, len(ids), 37):
        assert codes[i] == ids[i]


def test_codes_table(spark):
    got = rows(dac.round_trip(edge_table(spark), PATH))
    want, start = [], 0
    for i, t in sorted(EDGES, key=lambda e: (e[0] is not None, e[0] or 0)):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want, key=str)
    assert dac.round_trip(edge_table(spark).limit(0), PATH).count() == 0


def test_token_at(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} and more text {i}") for i in range(50)], "doc_id long, text string")
    dac.write(df, str(tmp_path / "d"), PATH, segment_tokens=60)
    flat = [t for i in range(50) for t in [*LIBRARY.encode(f"word{i} and more text {i}", add_special_tokens=False).ids, 1]]
    for at in (0, 59, 60, len(flat) - 1):
        assert dac.token_at(spark, str(tmp_path / "d"), at) == flat[at]
    assert dac.token_at(spark, str(tmp_path / "d"), len(flat)) is None


def test_template_automata_equal_regular_expressions():
    rnd = random.Random(5)
    more = {"first": '<<var;name="x";match=".+">> a b', "either": '<<var;match="a b|a c|d">> e <<var;original="f g">> h', "some": 'a <<var;match=".{1,2}">> b <<beginOptional;name="o">>c<<endOptional>>', "long": 'a <<var;match=".{0,5000}">> b'}
    tokens = lambda t: [w.decode() for w in licences.words(re.sub("<<.*?>>", " ", t))]
    words = sorted({w for t in licences.TEMPLATES.values() for w in tokens(t)})[:40] + ["x", *"abcdefgh"]
    for label, template in (licences.TEMPLATES | more).items():
        a, pattern = licences.compile_template(template), re.compile(licences.template_regex(template))
        plain = tokens(template)
        for _ in range(60):
            text = [w for w in plain if rnd.random() > 0.03]
            if rnd.random() < 0.5:
                text.insert(rnd.randrange(len(text) + 1), rnd.choice(words))
            if label in more:
                text = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))]
            found = any((a.any_first or w.encode() in a.firsts) and a.accepts([x.encode() for x in text], i) for i, w in enumerate(text))
            assert found == bool(pattern.search(" " + " ".join(text) + " ")), (label, text)


def test_licence_table(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License. Under the MIT license"), (2, "licensed under a CC BY-NC 4.0 license"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "under the mitt license"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"]) == (2, 1, 5, "mit", "mit,mit-notice")
    assert got[2]["labels"] == "cc-by-nc,cc-by-nc-4"
    assert got[3]["labels"] == "gpl-3" and got[3]["n_base"] == 0
    assert got[4]["labels"] == "" and got[4]["score"] == 0
    assert (got[5]["n_words"], got[5]["first_word"]) == (0, None)
    assert licences.scan(edge_table(spark)).count() == len(EDGES)
    for wrong in ("a <<beginOptional>> b", "a <<endOptional>> b", '<<var;match=".+">>', "a <<other>> b", 'a <<var;match="[a-z]+">> b', "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licences.compile_template(wrong)


def test_whole_licences(spark):
    """Whole texts with another holder, another bullet and other line breaks; one that lacks a mandatory word is none."""
    fill = lambda t, **names: re.sub(r'<<var;name="(\w+)";original="([^"]*)".*?>>', lambda m: names.get(m[1], m[2]), re.sub("<<(begin|end)Optional>>", "", t))
    mit, bsd = licences.TEMPLATES["mit-text"], licences.TEMPLATES["bsd-text"]
    texts = [
        fill(mit, liable="Ann B. Example and others", copyright="2020 Ann"),
        fill(mit).replace("without restriction", "with restriction"),
        fill(bsd, bullet1="*", bullet2="*", bullet3="*", holder="Example Ltd.").replace("\n", "\n\n// "),
        "x " * 50 + fill(licences.TEMPLATES["isc-text"], author="ANN") + " y",
    ]
    got = {r["doc_id"]: r["labels"].split(",") for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[label for label in got[i] if label.endswith("-text")] for i in range(4)] == [["mit-text"], [], ["bsd-text"], ["isc-text"]]


def _auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert _auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.95
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.classify(edge_table(spark).withColumnRenamed("score", "predicted"), labels)
    assert got.count() == len(EDGES) and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.classify(edge_table(spark).limit(0), labels).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_language_brute_force():
    """Ranks and distances as the plain definition has them."""
    texts = {"a": "the cat and the hat", "b": "le chat et la chatte"}
    top = {}
    for name, t in texts.items():
        g, n = language.gram_counts(t)
        top[name] = language.ranked(g, n).tolist()
    model = language.Profiles(top)
    for t in ("the chat", "la hat", "et cetera the"):
        mine = language.ranked(*language.gram_counts(t)).tolist()
        far = {k: sum(abs(i - p.index(g)) if g in p else language.PROFILE for i, g in enumerate(mine)) for k, p in top.items()}
        best = min(sorted(far), key=far.get)
        assert model.predict(t) == (best, 1 - far[best] / (language.PROFILE * len(mine)))


def test_language_edges(spark):
    df = edge_table(spark).selectExpr("*", "if(doc_id = 4, 'en', null) as lang")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df).collect()}
    assert got[1] == got[2] == got[5] == got[6] == "und"
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", df["text"].substr(0, 0))).where("doc_id < 3").collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_word_hashes_and_shingles():
    assert len(word_hashes("Ab, ab ABé ")) == 3
    a = word_hashes("one two three")
    assert (word_hashes("  ONE-two three!") == a).all()
    x, y = shingles("a b c d e f"), shingles("a b c d e f g")
    assert weighted_jaccard(x, y) == 2 / 3
    assert len(shingles("a b")[0]) == 1 and len(shingles(" ")[0]) == 0


def test_chroma_alignment_and_table(spark):
    rnd = random.Random(3)
    tune = bytes(rnd.randrange(256) for _ in range(6000))
    a, shifted = chroma.fingerprint(tune, chroma.SHORT), chroma.fingerprint(bytes(chroma.SHORT.hop * 40) + tune, chroma.SHORT)
    assert chroma.align(a, shifted)[0] == 40 and chroma.align(a, a) == (0, 0.0, len(a))
    other = bytes(rnd.randrange(256) for _ in range(6000))
    media = [(100, tune), (1, tune), (2, bytes(chroma.SHORT.hop * 40) + tune), (3, other), (200, other), (300, b"ab"), (400, None), (5, tune)]
    df = spark.createDataFrame([(i, m, "x") for i, m in media], "doc_id long, media binary, n_frames string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in chroma.report(df, F.col("doc_id") % 100 == 0, frames=chroma.SHORT).collect()}
    assert (got[100]["match_id"], got[100]["bit_error"], got[100]["match_offset"]) == (1, 0.0, 0)
    assert got[200]["match_id"] == 3 and got[300]["match_id"] is None and got[400]["n_codes"] == 0 and got[1]["match_id"] is None
    ranked = chroma.matches(chroma.fingerprints(df, frames=chroma.SHORT), F.col("doc_id") == 100, 3).orderBy("rank").collect()
    assert [r["match_id"] for r in ranked] == [1, 5, 2]
    assert chroma.report(df.limit(0), F.lit(True)).count() == 0


def test_semitones_fall_into_their_classes():
    """Twelve tones of one octave are twelve pitch classes, and an octave higher the same ones."""
    at = np.arange(chroma.AUDIO.size * 3) / chroma.AUDIO.rate
    tone = lambda f: (128 + 100 * np.sin(2 * np.pi * f * at)).astype(np.uint8).tobytes()
    found = [[int(chroma.chroma(tone(f * 2 ** (k / 12)))[1].argmax()) for k in range(12)] for f in (220.0, 440.0)]
    assert found[0] == found[1] == list(range(12))


def test_best_alignments_are_those_of_brute_force(spark):
    """Of random recordings that share passages, each query's best match over all is found."""
    rng = np.random.default_rng(8)
    parts = [rng.integers(60, 200, 1600, dtype=np.uint8).tobytes() for _ in range(6)]
    media = [(i, b"".join(parts[p] for p in rng.integers(0, 6, 2)) + rng.integers(60, 200, 300, dtype=np.uint8).tobytes()) for i in range(24)]
    prints = {i: chroma.fingerprint(m, chroma.SHORT) for i, m in media}
    got = {r["doc_id"]: r for r in chroma.report(spark.createDataFrame(media, "doc_id long, media binary"), F.col("doc_id") % 4 == 0, frames=chroma.SHORT).collect()}
    for q in range(0, 24, 4):
        best = []
        for i, fp in prints.items():
            votes: dict[int, int] = {}
            for x, a in enumerate(prints[q]):
                for y in np.flatnonzero(fp == a):
                    votes[int(y) - x] = votes.get(int(y) - x, 0) + 1
            top = sorted((-n, o) for o, n in votes.items())
            if i == q or not top or -top[0][0] < chroma.SHARED:
                continue
            o = top[0][1]
            low, high = max(0, o), min(len(fp), len(prints[q]) + o)
            error = int(np.bitwise_count(fp[low:high] ^ prints[q][low - o : high - o]).sum()) / (32 * (high - low))
            if error <= chroma.ERROR:
                best.append((error, -(high - low), i, o))
        want = min(best, default=(None, None, None, None))
        assert (got[q]["match_id"], got[q]["match_offset"], got[q]["bit_error"]) == (want[2], want[3], want[0])


def test_long_and_repeated_recordings(spark):
    media = [(100, b"a" * 400_000), (1, b"a" * 400_000), (1, b"a" * 400_000), (None, b"ab" * 9000), (200, None), (200, b"")]
    got = [tuple(r)[:1] + (r["match_id"],) for r in chroma.report(spark.createDataFrame(media, "doc_id long, media binary"), F.col("doc_id") % 100 == 0, frames=chroma.SHORT).collect()]
    assert sorted(got, key=str) == sorted([(100, 1), (1, None), (1, None), (None, None), (200, None), (200, None)], key=str)


def test_ftrl_is_the_written_out_update():
    """Updates and weights, coordinate by coordinate, as the method's paper has them."""
    import math

    rng = np.random.default_rng(3)
    model, z, n = quality.Ftrl(8), [0.0] * 8, [0.0] * 8

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(200):
        at = np.sort(rng.choice(8, 3, replace=False))
        x, label = rng.random(3), float(rng.integers(0, 2))
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, wi, xi in zip(at, w, x, strict=True):
            g = (p - label) * xi
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha
            z[i] += g - s * wi
            n[i] += g * g
        model.update(at, x, label)
    assert np.allclose(model.weights(), [weight(i) for i in range(8)])


def test_ids_next_to_a_null_stay_exact(spark, tmp_path):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "one two"), (None, "three"), (big + 1, "four")], "doc_id long, text string").coalesce(1)
    dac.write(df, str(tmp_path / "codes"), tokenizer_path(), partitions=1)
    assert [r["doc_id"] for r in dac.documents(spark, str(tmp_path / "codes")).orderBy("start").collect()] == [None, big, big + 1]
