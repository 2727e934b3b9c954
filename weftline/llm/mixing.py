"""Mixing sources to target weights by Poisson replication.

A source that has n of N rows and the target share w is repeated at the mean
rate w * N / n.  Each row inverts the Poisson distribution of its source's rate
at a point that is hashed from its id and the seed, and appears that many
times; copies are then ordered by a hash of id and copy, over all partitions.
Rows without an id, or with one that other rows have too, are told apart by their
content and by a number among equal rows, so each has a draw of its own.
Nothing depends on where a row lies, so lost tasks give the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rate above this is drawn as the sum of several draws of equal smaller rates, for exp() not to vanish.
LARGEST = 500.0
#: The rate table is broadcast up to this many sources; beyond, it is joined.
BROADCAST_SOURCES = 10_000


def unit(*parts: Column) -> Column:
    """A number in (0, 1) hashed from its parts, from 52 bits of md5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(df: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """(source, n, rate) by counting all rows.

    Shares are the given weights, or in proportion to n ** power; sources without
    a weight have the share 0.  Null is a source of its own, weighted as "".
    """
    counts = df.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_n"))
    if weights is None:
        counts = counts.withColumn("mix_weight", F.pow(F.col("mix_n").cast("double"), F.lit(float(power))))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        counts = counts.withColumn("mix_weight", F.coalesce(F.try_element_at(given, F.col("mix_source")), F.lit(0.0)))
    total = counts.agg(F.sum("mix_n").alias("mix_all"), F.sum("mix_weight").alias("mix_total"))
    share = F.when(F.col("mix_total") > 0, F.col("mix_weight") / F.col("mix_total")).otherwise(0.0)
    return counts.join(F.broadcast(total)).select("mix_source", "mix_n", (share * F.col("mix_all") / F.col("mix_n")).alias("mix_rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as doubles tell them apart from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step)["all"]


def _told_apart(df: DataFrame, id_col: str) -> DataFrame:
    """The rows with ``mix_id``: their id as text; where it is null or repeats, id, digest of the row, and number among equal rows.

    Only such rows are shuffled here, and equal ones as one row and their count.
    """
    name = F.col(id_col).cast("string")
    repeated = df.groupBy(name.alias("mix_id")).agg(F.count(F.lit(1)).alias("mix_n")).where(F.col("mix_id").isNull() | (F.col("mix_n") > 1)).select("mix_id")
    if repeated.isEmpty():
        return df.withColumn("mix_id", name)
    named, on = df.withColumn("mix_id", name), "mix_id"
    once = named.where(name.isNotNull()).join(repeated, on, "left_anti")
    again = named.where(name.isNull()).unionByName(named.where(name.isNotNull()).join(repeated.where("mix_id IS NOT NULL"), on, "left_semi"))
    whole = F.struct(*[F.col(f"`{n}`") for n in df.columns])
    equal = again.groupBy(F.coalesce("mix_id", F.lit("")).alias("mix_id"), F.sha2(F.to_json(whole), 256).alias("mix_key")).agg(F.first(whole).alias("mix_row"), F.count(F.lit(1)).alias("mix_n"))
    each = equal.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_n"))))
    told = F.concat_ws("|", "mix_id", "mix_key", F.col("mix_copy").cast("string"))
    return once.unionByName(each.select("mix_row.*", told.alias("mix_id")))


def mix(df: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The rows of ``df``, each as often as its Poisson draw says, in hashed order.

    Adds ``mix_rate``, ``mix_copy`` (from 1) and ``mix_key`` (the order).  Rows
    with null or repeated ids each draw for themselves, equal rows too.  A rate of 0
    drops the source, an empty table stays empty.  Columns whose names start
    with ``mix_`` are replaced.
    """
    df = df.drop("mix_source", "mix_n", "mix_rate", "mix_copy", "mix_key", "mix_id", "mix_parts", "mix_cdf")
    found = rates(df, source_col, weights, power)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / LARGEST)).cast("int")
    table = found.withColumn("mix_parts", parts).withColumn("mix_cdf", _distribution(F.col("mix_rate") / F.col("mix_parts")))
    if found.select("mix_source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = _told_apart(df, id_col).withColumn("mix_source", F.coalesce(F.col(source_col), F.lit(""))).join(table, "mix_source")

    def draw(part: Column) -> Column:
        u = unit(F.lit(str(seed)), F.col("mix_id"), part.cast("string"))
        return F.size(F.filter(F.col("mix_cdf"), lambda c: u >= c))

    count = F.aggregate(F.sequence(F.lit(0), F.col("mix_parts") - 1), F.lit(0), lambda acc, part: acc + draw(part))
    copies = rows.withColumn("mix_copy", F.sequence(F.lit(0), count)).withColumn("mix_copy", F.explode(F.slice("mix_copy", 2, F.greatest(F.size("mix_copy"), F.lit(1)))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "mix_id", F.col("mix_copy").cast("string")))).drop("mix_id", "mix_source", "mix_n", "mix_parts", "mix_cdf")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(n, "mix_key").sortWithinPartitions("mix_key")


def mix_sql(power: float = 0.5, seed: int = 7) -> str:
    """DuckDB SQL for :func:`mix` over ``documents``, for rates up to LARGEST."""
    return f"""
WITH counts AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {power}) AS w FROM documents GROUP BY 1
), rates AS (
  SELECT s, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM counts
), steps AS (
  SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates
), cdf AS (
  SELECT s, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(CAST(k + 1 AS DOUBLE)))) OVER (PARTITION BY s ORDER BY k) AS c FROM steps
), lists AS (SELECT s, rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY s, rate), drawn AS (
  SELECT doc_id, source, rate, coalesce(CAST(doc_id AS VARCHAR), '') AS id, cs,
    (CAST(('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|0'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents JOIN lists ON s = coalesce(source, '')
), copies AS (
  SELECT doc_id, source, rate, id, unnest(range(1, len(list_filter(cs, lambda c: u >= c)) + 1)) AS copy FROM drawn
)
SELECT doc_id, source, round(rate, 9) AS mix_rate, CAST(copy AS INTEGER) AS mix_copy,
  md5('order{seed}|' || id || '|' || CAST(copy AS VARCHAR)) AS mix_key
FROM copies
"""
