"""Benchmark passages in documents: a prefix-filtered join of word shingles, in DataFrame functions only.

An item's windows are its runs of ``window`` words; an item of fewer words is one
window.  A window's set elements are its shingles of five words (of all its words,
where it has fewer).  As a document must hold all of them, the prefix of a window is
its one rarest shingle, by how often the documents hold it, and a window with
a shingle that no document holds is out.  Shingles of documents meet prefixes by an equi-join; a meeting says where the window
would have to lie (the position of the prefix in it, its length against what the
document has on either side), and the words there are compared with the windows.

Documents are split into words once.  Of their shingles only those are written that a
bitmap of the items' shingles may hold; it is a bounded literal (:data:`BITS`), and
what it lets through wrongly finds no partner in the join.

Defined cases: null and empty texts have no words and no hits; without items nothing
is contaminated; an item is known by its id as text (null: empty), so rows that repeat an id are one item;
repeated documents are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import shared_folder, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of a shingle.
SHINGLE = 5
#: Places of the bitmap: 64 for each shingle of the items, up to so many.
BITS = 1 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; other letters stay as they are."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingles(hashes: str, n: str, size: int) -> str:
    """SQL for (p, h) of all shingles of ``size`` words; places count from 1."""
    parts = ", ".join(f"get({hashes}, i + {j - 1})" for j in range(size))
    return f"if({n} >= {size}, transform(sequence(1, greatest({n} - {size - 1}, 1)), i -> named_struct('p', i, 'h', xxhash64({parts}))), array())"


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """(item, text, n): the windows of each item, as their words joined by one space, and their number of words."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col).cast("string")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("at", F.explode(F.expr(f"sequence(1, greatest(size(words) - {window - 1}, 1))")))
    cut = F.slice("words", F.col("at"), F.lit(window))
    return rows.select("item", F.array_join(cut, " ").alias("text"), F.least(F.size("words"), F.lit(window)).alias("n")).distinct()


def _tokens(found: DataFrame) -> DataFrame:
    """(text, n, o, h): the shingles of each different window and their places in it, from 0."""
    hashed = found.select("text", "n").distinct().withColumn("wh", F.expr("transform(split(text, ' '), w -> xxhash64(w))"))
    small = " ".join(f"when n = {size} then {_shingles('wh', 'n', size)}" for size in range(1, SHINGLE))
    each = F.explode(F.expr(f"case {small} else {_shingles('wh', 'n', SHINGLE)} end"))
    return hashed.select("text", "n", each.alias("s")).select("text", "n", (F.col("s.p") - 1).alias("o"), F.col("s.h").alias("h"))


def _bitmap(tokens: DataFrame) -> tuple[int, str]:
    """How many places the bitmap has, and it as SQL: longs of which bit ``h`` and bit ``h >> 32`` are set for each shingle."""
    n = tokens.select("h").distinct().count()
    size = 1 << max(6, min(BITS.bit_length() - 1, (64 * n - 1).bit_length()))
    places = tokens.select("h").distinct().select(F.explode(F.array("h", F.shiftright("h", 32))).alias("h")).select((F.col("h").bitwiseAND(size - 1)).alias("b"))
    longs = places.groupBy(F.shiftright("b", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    bits = dict(longs.collect())  # at most BITS / 64 rows
    return size, ",".join(str(bits.get(k, 0)) for k in range(size >> 6))


def _candidates(docs: DataFrame, id_col: str, text_col: str, tokens: DataFrame, base: str, window: int) -> DataFrame:
    """(doc_id, rid, n, found): each document's shingles that the bitmap lets through, with the words around them."""
    size, bits = _bitmap(tokens)
    sizes = sorted({min(r["n"], SHINGLE) for r in tokens.select("n").distinct().collect()} | {SHINGLE})  # window lengths
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    rows = rows.select("doc_id", "words", F.size("words").alias("n"), F.expr("transform(words, w -> xxhash64(w))").alias("wh"))
    table = f"cast(split('{bits}', ',') as array<bigint>)"
    test = " and ".join(f"getbit(get({table}, cast(shiftright({h} & {size - 1}, 6) as int)), cast({h} & 63 as int)) = 1" for h in ("s.h", "shiftright(s.h, 32)"))
    some = ", ".join(f"filter({_shingles('wh', 'n', k)}, s -> {test})" for k in sizes)
    rows = rows.select("doc_id", "n", "words", F.expr(f"concat({some})").alias("found"))
    around = f"named_struct('p', s.p, 'h', s.h, 'from', greatest(s.p - {window - 1}, 1), 'words', slice(words, greatest(s.p - {window - 1}, 1), s.p - greatest(s.p - {window - 1}, 1) + {window}))"
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), "n", F.expr(f"transform(found, s -> {around})").alias("found"))
    return written(rows, "candidates", base)  # row ids are fixed from here on


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as (doc_id, rid, n), where windows occur as (rid, start, n, text), and the windows as (item, text, n).

    Places count words from 1; ``rid`` tells rows apart, also those that repeat an id.
    """
    base = shared_folder(docs.sparkSession)
    found = written(windows(items, item_col, item_text, window), "windows", base)
    tokens = written(_tokens(found), "tokens", base)
    rows = _candidates(docs, id_col, text_col, tokens, base, window)
    each = rows.select("rid", "n", F.explode("found").alias("s")).select("rid", F.col("n").alias("total"), "s.*")
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    prefix = tokens.join(counts, "h").groupBy("text", "n").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("docs", "o", "h")).alias("p"))
    prefix = prefix.where(F.col("held") == F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1)))
    # at most some twenty places of a prefix in windows of different lengths
    places = written(prefix.groupBy(F.col("p.h").alias("h")).agg(F.collect_set(F.struct(F.col("p.o").alias("o"), F.col("n").alias("m"))).alias("places")), "prefixes", base)
    met = each.join(places, "h").select("rid", "p", "from", "words", "total", F.explode("places").alias("at")).withColumn("start", F.col("p") - F.col("at.o"))
    met = met.where((F.col("start") >= 1) & (F.col("start") + F.col("at.m") - 1 <= F.col("total")))
    cut = F.slice("words", F.col("start") - F.col("from") + 1, F.col("at.m"))
    met = met.select("rid", "start", F.col("at.m").alias("n"), F.array_join(cut, " ").alias("text"))
    hits = written(met.join(found.select("text").distinct(), "text", "left_semi"), "hits", base)
    return rows.select("doc_id", "rid", "n"), hits, found


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Of each document: its words, those within any occurrence of a window, and the items whose windows occur."""
    rows, hits, found = occurrences(docs, items, window=window)
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0))), F.lit(0))
    words = hits.select("rid", new.alias("new")).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    # windows that the same items hold are one class, and documents with the same classes share one list of items
    held = found.join(hits.select("text").distinct(), "text").groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = written(held.withColumn("class", F.sha2(F.to_json("items"), 256)), "held")
    sets = hits.select("rid", "text").join(held.select("text", "class"), "text").groupBy("rid").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    one = sets.select("classes").distinct().select("classes", F.explode("classes").alias("class"))
    lists = one.join(held.select("class", "items").distinct(), "class").groupBy("classes").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    lists = lists.select("classes", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("digest"))
    named = sets.join(lists, "classes").select("rid", "n_items", "digest")
    whole = rows.join(words, "rid", "left").join(named, "rid", "left")
    return whole.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def report_sql(window: int = 10) -> str:
    """DuckDB SQL for :func:`report` over ``documents`` and ``benchmark``."""
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS w FROM benchmark),
cuts AS (SELECT item, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS pos FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[pos : pos + {window - 1}], ' ') AS t, least(len(w), {window}) AS n FROM cuts),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS pos FROM docs),
hits AS (
  SELECT DISTINCT p.rid, p.pos, k.n, array_to_string(p.w[p.pos : p.pos + k.n - 1], ' ') AS t
  FROM places p, (SELECT DISTINCT n FROM windows) k
  WHERE p.pos + k.n - 1 <= len(p.w) AND array_to_string(p.w[p.pos : p.pos + k.n - 1], ' ') IN (SELECT t FROM windows)
),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits JOIN windows USING (t)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
