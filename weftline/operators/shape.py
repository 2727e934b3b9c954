"""Tables from long to wide and back, and other whole-table steps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.lang.values import is_number
from weftline.plans import scan
from weftline.plans.scan import numbered
from weftline.shared import shared_folder, written

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def register_transform(name: str):
    def add(fn):
        TRANSFORMS[name] = fn
        return fn

    return add


def transform(name: str, df: DataFrame, args: list) -> DataFrame:
    """``transform::v4h`` and the like by name; ``conv::`` is the older prefix."""
    short = name.removeprefix("transform::").removeprefix("conv::")
    if short not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}")
    return TRANSFORMS[short](df, *args)


@register_transform("v4h")
def v4h(df: DataFrame, key: str = "key", value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Wide to long: every column that is not kept becomes a row of (key, value)."""
    keep = keep or []
    others = [c for c in df.columns if c not in keep]
    return df.unpivot([F.col(c) for c in keep], others, key, value)


@register_transform("h2v")
def h2v(df: DataFrame, hkey: str, vkey: str, value: str = "value") -> DataFrame:
    """Wide to long around one identifying column."""
    others = [c for c in df.columns if c != hkey]
    return df.unpivot([F.col(hkey)], others, vkey, value)


def _cell(df: DataFrame, value: str | None, order: str | None) -> Column:
    if value is None:
        return F.count(F.lit(1))
    if is_number(df.schema[value].dataType):
        return F.sum(value)
    return F.max_by(value, order)


def _arriving(df: DataFrame, order: str | None) -> tuple[DataFrame, str]:
    """The table and the column of its order: the given one, or the rows' order of arrival."""
    return (df, order) if order else (df.withColumn("__arrival", F.monotonically_increasing_id()), "__arrival")


def _filled(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(0).cast(df.schema[n].dataType)) for n in names if n in df.columns})


@register_transform("v2h")
def v2h(df: DataFrame, hkey: str, vkey: str, value: str | None = None, columns: list | None = None, order: str | None = None) -> DataFrame:
    """Long to wide: a row for each ``vkey``, a column for each ``hkey``; sums, the last of what is no number, or counts; 0 where nothing is.

    Given columns save the pass that finds them.
    """
    df, order = _arriving(df, order)
    out = df.groupBy(vkey).pivot(hkey, columns).agg(_cell(df, value, order)) if columns else df.groupBy(vkey).pivot(hkey).agg(_cell(df, value, order))
    return _filled(out, [c for c in out.columns if c != vkey])


def _runs(df: DataFrame, id_col: str, place: str, into: str) -> DataFrame:
    """Numbers the stretches of rows with the same id, along ``place``; the rows come with a place of their own.

    Rows are sorted over range partitions and written.  Each partition counts where its id changes; of
    each, only its ends and its count meet in one window, which tells with which number it begins.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, place).sortWithinPartitions(place, id_col).withColumn("__at", F.monotonically_increasing_id())
    df = written(ranged.withColumn("__part", F.shiftright("__at", 33)).drop(place), shared_folder(df.sparkSession)).withColumnRenamed("__at", place)
    own = F.struct(F.col(f"`{id_col}`").alias("v"))  # null only where there is no row
    along, parts = Window.partitionBy("__part").orderBy(place), Window.orderBy("__part")
    begins = (~own["v"].eqNullSafe(F.lag(own).over(along)["v"]) | F.lag(own).over(along).isNull()).cast("long")
    df = df.withColumn("__begins", begins)
    ends = df.groupBy("__part").agg(F.min_by(own, place).alias("first"), F.max_by(own, place).alias("last"), F.sum("__begins").alias("n"))
    last = F.lag("last").over(parts)
    goes_on = (last.isNotNull() & last["v"].eqNullSafe(F.col("first")["v"])).cast("long")  # the run of the partition before
    ends = ends.withColumn("__n", F.col("n") - goes_on)
    before = ends.select("__part", (F.sum("__n").over(parts) - F.col("n")).alias("__before"))
    counted = df.withColumn("__within", F.sum("__begins").over(along))
    return counted.join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + F.col("__within")).drop("__part", "__begins", "__within", "__before")


@register_transform("h4v")
def h4v(df: DataFrame, key: str, value: str, id: str | None = None, columns: list | None = None, order: str | None = None) -> DataFrame:  # noqa: A002
    """Rows of (key, value) to wide rows; a new row starts where the id changes or a key comes again.

    Rows go along ``order``, or as they arrive; wide rows have the id, if one is
    named, and a column for each key.  No row is lost.
    """
    df, order = _arriving(df, order)
    if id is not None:
        df = _runs(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id, key, value])], F.col(f"`{order}`").alias("__place")), id, "__place", scan.KEY)
    else:
        df, place = numbered(df, F.col(order))
        df = df.withColumn("__place", place).withColumn(scan.KEY, F.lit(0).cast("long"))
    kept = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*([id] if id is not None else []), key, value])], F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("None")).alias("__k"))
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("seen", T.ArrayType(T.StringType()))])

    def step(state: Column, row: Column) -> Column:
        again = F.coalesce(F.array_contains(state["seen"], row["__k"]), F.lit(True))
        n = F.coalesce(state["n"], F.lit(0)) + F.when(again, 1).otherwise(0)
        seen = F.when(again, F.array(row["__k"])).otherwise(F.concat(state["seen"], F.array(row["__k"])))
        return F.struct(n.cast("long").alias("n"), seen.alias("seen")).cast(kind)

    made = scan.Scan(scan.each(step, kind), kind, each=True).over(df.select(scan.KEY, "__place", kept.alias(scan.ROW)), [F.col("__place")])
    rows = made.select(F.col(scan.KEY).alias("__run"), F.col(f"{scan.STATE}.n").alias("__wide"), f"{scan.ROW}.*").drop("__k")
    keep = ["__run", "__wide", *([id] if id is not None else [])]
    pivot = rows.groupBy(*keep).pivot(key, columns) if columns else rows.groupBy(*keep).pivot(key)
    return pivot.agg(F.any_value(F.col(f"`{value}`"))).drop("__run", "__wide")  # a key comes once in a wide row


@register_transform("uniqkv")
def uniqkv(df: DataFrame, uniq: str, key: str, value: str, order: str | None = None, columns: list | None = None) -> DataFrame:
    """The first row of each ``uniq``, with a column for each key; null is the key ``None``.

    Keys that are not given are found first; more than Spark's own pivot allows are refused.
    """
    rest = [c for c in df.columns if c not in (uniq, key, value)]
    first = [(F.min_by(c, order) if order else F.first(c)).alias(c) for c in rest]
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    names = columns or [r[0] for r in df.select(key).distinct().orderBy(key).limit(most + 1).collect()]
    if not columns and len(names) > most:
        raise ValueError(f"more than {most} keys in {key}; name the columns or raise spark.sql.pivotMaxValues")
    labels: dict[str, list] = {}
    for n in names:
        labels.setdefault(str(n), []).append(n)
    hit = lambda ns: reduce(or_, [F.col(key).eqNullSafe(n) for n in ns])
    cell = lambda ns: F.when(hit(ns), F.col(value))
    number = is_number(df.schema[value].dataType)
    cells = [(F.coalesce(F.sum(cell(ns)), F.lit(0)) if number else F.max_by(value, F.when(hit(ns), F.col(order))) if order else F.last(cell(ns), ignorenulls=True)).alias(label) for label, ns in labels.items()]
    return df.groupBy(uniq).agg(*first, *cells)


@register_transform("union")
def union(df: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several tables by column name; missing columns are null."""
    for o in others:
        df = df.unionByName(o, allowMissingColumns=True)
    return df
