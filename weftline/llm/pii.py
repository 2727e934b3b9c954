"""Personal data: base patterns, and contexts bootstrapped from what they find.

Everything here is DataFrame expressions.  Base entities are found by regular
expressions.  They are the seeds, and so are tokens that look like keys (long runs
of letters and digits that change often, the kind ``secret``).  What stands around
them are lexical patterns: two words before; one word before and one after; a
label and a separator before; and for long tokens the way they begin.  Other base
entities are one filler there.  Tokens that hold a digit, "@" or many capitals and
stand in the same patterns are candidate instances.  Patterns and
instances form a graph, counted over the whole table, and are scored in turns:

* a pattern's confidence for a kind is the mean score of the distinct instances
  it was seen with, if at least ``support`` of them carry score;
* an instance's score for a kind is 1 - prod(1 - confidence) over its patterns
  of at least ``confident``; seeds keep the score 1.

After the last turn, candidates that stand in a confident pattern and reach
``accept`` are spans of the kind ``<kind>_context``.  A key is a seed by its looks
only, so it becomes a span, of the kind ``secret``, by the same test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, shared_folder, written

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:long,end:long,value:string>"
SEEN = "struct<kind:string,start:long,end:long,value:string,patterns:array<string>>"

# The base patterns, written so that Java's matcher takes time in proportion to the text:
# runs are possessive, repeated groups of unbounded length are lazy classes with look-ahead,
# and a start inside a run that has failed is not tried again.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?=\.{_HOST})[A-Za-z0-9.-]*?(?=\.(?!{_HOST})|(?![A-Za-z0-9.-]))"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![0-9])(?![ -][0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = r"""[^\s"'=:<>(),;\[\]{}|\uFDD0-\uFDEF]"""
TOKEN = rf"(?<!{_PART})(?={_PART}*?[0-9@]|[A-Z]{{12}}){_PART}+(?<![.!?])"
FILLER = "\uFDD0"
SECRET = "secret"
#: Characters of a word of a pattern at most; so many characters beside a place hold two of them.
WORD, WIDE = 64, 160
#: Characters of the pieces that a text is cut from.
CHUNK = 1024


#: Matches are walked in blocks of so many, for arrays to grow in little pieces.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def _pairs(text: Column, pattern: str) -> Column:
    """The gaps between matches and the matches that follow them, in order; the last gap has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def _starts(pairs: Column) -> Column:
    """Where each match starts, in code points: sums of the lengths before it, first within blocks, then over blocks."""
    length = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))
    empty = F.array().cast("array<long>")

    def block(k: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            return F.struct((acc["at"] + length(p)).alias("at"), F.array_append(acc["all"], acc["at"] + F.length(p["gap"])).alias("all"))

        return F.aggregate(F.slice(pairs, k * BLOCK + 1, BLOCK), F.struct(F.lit(0).cast("long").alias("at"), empty.alias("all")), step)

    def join(acc: Column, b: Column) -> Column:
        return F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["all"], F.transform(b["all"], lambda x: x + acc["at"])).alias("all"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), block)
    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<long>>").alias("all")), join)["all"])


def _spans(text: Column, pattern: str, kind: str, when: Column, valid) -> Column:
    """The valid matches of a pattern with their places in code points."""

    def span(p: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(p["match"])).alias("end"), p["match"].alias("value"))

    none = F.array().cast(f"array<{SPAN}>")
    found = _let(_pairs(text, pattern), lambda pairs: F.filter(F.zip_with(pairs, _starts(pairs), span), lambda s: s["value"].isNotNull() & valid(s["value"])))
    return F.when(when & F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_valid(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))).between(0, 3) & (F.coalesce(F.ltrim(part, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """The base spans of a text that isn't null, by kind as listed, then by start."""
    digit, at, plus = F.regexp_like(text, F.lit("[0-9]")), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    count = lambda m: F.length(_digits(m))
    return F.concat(
        _spans(text, EMAIL, "email", at, lambda m: F.lit(True)),
        _spans(text, IP, "ip", digit, _ip_valid),
        _spans(text, CARD, "card", digit, lambda m: F.call_function("luhn_check", _digits(m))),
        _spans(text, PHONE, "phone", digit & plus, lambda m: count(m).between(8, 15)),
    )


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text that lies in chunks of CHUNK; takes time for these and one chunk."""
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    first, last = (start - i * CHUNK).cast("int"), (end - j * CHUNK).cast("int")
    here = F.substring(F.get(chunks, i), first + 1, (end - start).cast("int"))
    over = F.concat(F.substring(F.get(chunks, i), first + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(chunks, j), F.lit(1), last), F.lit("")))
    return F.coalesce(F.when(i == j, here).otherwise(over), F.lit(""))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _covered(text: Column, spans: Column, by: Column) -> Column:
    """The text with every character within the spans replaced by the character ``by``; spans ascend and don't overlap."""

    def made(chunks: Column) -> Column:
        end = lambda i: F.coalesce(F.get(spans, i)["end"], F.lit(0).cast("long"))
        parts = F.transform(spans, lambda s, i: F.concat(_cut(chunks, end(i - 1), s["start"]), F.repeat(by, (s["end"] - s["start"]).cast("int"))))
        return F.concat(F.array_join(parts, ""), _cut(chunks, end(F.size(spans) - 1), F.length(text).cast("long")))

    return F.when(F.size(spans) > 0, _let(_chunks(text), made)).otherwise(text)


def covered(text: Column, spans: Column, by: Column) -> Column:
    """:func:`_covered` for base spans, which overlap between kinds only: one kind after the other, as places stay."""
    for kind in KINDS:
        own = F.filter(spans, lambda s: s["kind"] == kind)  # noqa: B023  used at once
        text = _let(text, lambda t, own=own: _let(own, lambda some: _covered(t, some, by)))
    return text


def _patterns(left: Column, value: Column, right: Column) -> Column:
    """The patterns of a place from the covered text before and after it.

    Two words before; one word before and one after; a label before a separator;
    and how a long value is spelled: its first four letters and its length.  Words
    are lower-cased, with digits as 0 and covered identifiers as one filler; a word
    of more than WORD characters makes no pattern.  Fillers that touch the place
    belong to spans that adjoin it, and are passed over.
    """
    short = lambda c, touching: F.regexp_replace(F.regexp_replace(c, touching, ""), f"{FILLER}+", FILLER)
    left, right = short(left, f"(?<!{FILLER}){FILLER}+$"), short(right, f"^{FILLER}+")
    low = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    word = rf"(?<!\S)\S{{1,{WORD}}}"
    before = low(F.regexp_extract(left, rf"({word}\s+\S{{1,{WORD}}})\s*$", 1))
    near = low(F.regexp_extract(left, rf"({word})\s*$", 1))
    after = low(F.regexp_extract(right, rf"^\s*(\S{{1,{WORD}}})(?!\S)", 1))
    label = low(F.regexp_extract(left, rf"(?<![\p{{L}}_-])([\p{{L}}_-]{{2,{WORD}}})[\"']?\s{{0,8}}[:=]\s{{0,8}}[\"'(\[]?$", 1))
    start = F.regexp_extract(value, r"^([A-Za-z]{4})[A-Za-z0-9_-]{8,}$", 1)
    one = F.when(before != "", F.concat(F.regexp_replace(before, r"\s+", " "), F.lit(" _")))
    two = F.when((near != "") & (after != ""), F.concat(near, F.lit(" _ "), after))
    three = F.when(label != "", F.concat(F.lit("label "), label))
    four = F.when(start != "", F.concat(F.lit("spelled "), start, F.lit(" "), F.length(value).cast("string")))
    return F.array_compact(F.array(one, two, three, four))


def _seen(chunks: Column, kind: Column, start: Column, end: Column, value: Column) -> Column:
    left = _cut(chunks, F.greatest(start - WIDE, F.lit(0).cast("long")), start)
    return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), F.lower(value).alias("value"), _patterns(left, value, _cut(chunks, end, end + WIDE)).alias("patterns"))


def _is_secret(value: Column) -> Column:
    """A long run of letters and digits that change often, as keys and tokens have it; no UUID."""
    return F.regexp_like(value, F.lit("^[A-Za-z0-9_-]{16,}$")) & (F.regexp_count(value, F.lit("[A-Za-z](?=[0-9])")) >= 2) & ~F.regexp_like(value, F.lit("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"))


def _found(text: Column, base: Column) -> Column:
    """Seeds and candidates of a text: its base spans, and the tokens outside them that hold a digit, "@" or many capitals."""

    def tokens(covered_text: Column, chunks: Column) -> Column:
        def one(p: Column, start: Column) -> Column:
            return F.struct(start.alias("start"), (start + F.length(p["match"])).alias("end"), p["match"].alias("value"))

        every = _let(_pairs(covered_text, TOKEN), lambda pairs: F.zip_with(pairs, _starts(pairs), one))
        own = F.filter(every, lambda t: t["value"].isNotNull())
        return F.transform(own, lambda t: _seen(chunks, F.when(_is_secret(t["value"]), SECRET).otherwise(""), t["start"], t["end"], t["value"]))

    def both(covered_text: Column) -> Column:
        return _let(_chunks(covered_text), lambda chunks: F.concat(F.transform(base, lambda s: _seen(chunks, s["kind"], s["start"], s["end"], s["value"])), tokens(covered_text, chunks)))

    return F.when(F.regexp_like(text, F.lit("[0-9@]|[A-Z]{12}")), _let(covered(text, base, F.lit(FILLER)), both)).otherwise(F.array().cast(f"array<{SEEN}>"))


def _keyed(df: DataFrame, id_col: str, text_col: str, key: str, check: str) -> DataFrame:
    """Two hashes of id and text, 128 bits together, that tell rows apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumns({key: F.xxhash64(F.col(id_col), text), check: F.xxhash64(F.lit(1), text, F.col(id_col))})


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, row_check, base, seen): for each row its base spans, and all seeds and candidates with their patterns."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _keyed(rows, "id", "text", "row_key", "row_check").withColumn("base", base_spans(F.col("text")))
    return rows.select("id", "row_key", "row_check", "base", _found(F.col("text"), F.col("base")).alias("seen"))


def scored(found: DataFrame, turns: int = 2, support: int = 3, confident: float = 0.6, accept: float = 0.8, base: str | None = None) -> DataFrame:
    """(kind, pattern, value) of the candidates that the graph accepts."""
    base = base or shared_folder(found.sparkSession)
    each = found.select(F.explode("seen").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    all_edges = written(each.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "edges", base)
    # a pattern with fewer instances than the support never counts
    sizes = written(all_edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support), "sizes", base)
    edges = written(all_edges.join(sizes, "pattern"), "graph", base)
    seeds = edges.where(F.col("seed") != "").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    asked = edges.where(F.col("seed").isin("", SECRET))
    scores = seeds
    for turn in range(turns):
        carried = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.max("n").alias("n"))
        strong = carried.where(F.col("sum") >= support).select("pattern", "kind", F.least(F.col("sum") / F.col("n"), F.lit(0.999)).alias("confidence")).where(F.col("confidence") >= confident)
        strong = written(strong, f"patterns{turn}", base)
        reached = asked.join(strong, "pattern").where(F.col("seed").isin("", F.col("kind"))).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"), F.max("seed").alias("seed"))
        reached = written(reached, f"instances{turn}", base)
        scores = seeds.unionByName(reached.where(F.col("seed") == "").drop("seed"))
    good = reached.where(F.col("score") >= accept).select("value", "kind")
    return written(asked.join(strong, "pattern").join(good, ["value", "kind"]).select("kind", "pattern", "value").distinct(), "accepted", base)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", turns: int = 2, support: int = 3, confident: float = 0.6, accept: float = 0.8) -> DataFrame:
    """(id, row_key, row_check, base, learned): base spans and spans found by context, for each row.

    A null text counts as empty and has no spans.  Rows with the same id and text
    have the same keys and the same spans; an empty table gives an empty
    table.  Whole texts are searched, in time that grows with their length and the spans in them.
    """
    base = shared_folder(df.sparkSession)
    found = written(occurrences(df, id_col, text_col), "occurrences", base)
    good = scored(found, turns, support, confident, accept, base)
    keys = ["row_key", "row_check"]
    asked = found.select(*keys, F.explode("seen").alias("s")).where(F.col("s.kind").isin("", SECRET))
    candidates = asked.select(*keys, F.col("s.kind").alias("own"), "s.start", "s.end", "s.value", F.explode("s.patterns").alias("pattern"))
    kind = F.when(F.col("own") == F.col("kind"), F.col("kind")).otherwise(F.concat("kind", F.lit("_context")))
    hits = candidates.join(good, ["pattern", "value"]).select(*keys, F.struct(kind.alias("kind"), "start", "end", "value").alias("span")).distinct()
    learned = hits.groupBy(*keys).agg(F.array_sort(F.collect_list("span")).alias("learned"))
    none = F.array().cast(f"array<{SPAN}>")
    return found.select("id", *keys, "base").join(learned, keys, "left").select(F.col("id").alias(id_col), *keys, "base", F.coalesce("learned", none).alias("learned"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text, for each row."""
    found = detect(df, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    more = [F.size("learned").cast("long").alias("n_learned"), F.size(F.concat("base", "learned")).cast("long").alias("n_spans")]
    return found.select(id_col, *map(count, KINDS), *more, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "learned")).alias("spans"))


def _unused(text: Column) -> Column:
    """The first of the 32 noncharacters that the text doesn't hold; the first of all if it holds them all."""
    marks = [F.lit(chr(0xFDD0 + i)) for i in range(32)]
    return F.when(~F.contains(text, marks[0]), marks[0]).otherwise(F.coalesce(*[F.when(~F.contains(text, m), m) for m in marks[1:]], marks[0]))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[removed]") -> DataFrame:
    """The same rows and columns, every run of characters within spans of their texts replaced by ``mask``.

    Rows without spans keep their text as it is, null included.
    """
    key, check, spans, learned = fresh(df, "row_key", "row_check", "spans", "learned")
    found = detect(df, id_col, text_col).where(F.size("learned") > 0).select(F.col("row_key").alias(key), F.col("row_check").alias(check), F.col("learned").alias(learned)).dropDuplicates([key, check])
    rows = _keyed(df, id_col, text_col, key, check).join(found, [key, check], "left")
    places = F.array_sort(F.array_distinct(F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    places = F.coalesce(places, F.array().cast("array<struct<start:long,end:long>>"))
    text = F.col(text_col).cast("string")
    rows = rows.withColumn(spans, base_spans(F.coalesce(text, F.lit("")))).withColumn(learned, places)

    def clean(mark: Column) -> Column:
        both = _covered(covered(text, F.col(spans), mark), F.col(learned), mark)
        return F.regexp_replace(both, F.concat(mark, F.lit("+")), F.lit(mask))

    return rows.withColumn(text_col, F.when(F.size(spans) + F.size(learned) > 0, _let(_unused(text), clean)).otherwise(F.col(text_col))).select(*df.columns)
