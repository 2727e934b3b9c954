"""Folds whose order matters, over groups of any size.

Rows of a group go through a step one after the other.  A group of up to
:data:`CHUNK` rows is one sorted array of its task.  Larger groups are found by
counting; their rows are sorted over as many range partitions as there are, cut
into arrays of at most :data:`CHUNK` rows, and taken in rounds: each round takes
the next array of every such group, begins with the state that the group's last
round has left, and writes what it made.  So no task holds more than one array of a
group, and a round that is lost starts again from files.

A step is columns, so it runs inside Spark's own expressions.  Where each row's
state is asked for, an array is gone through in blocks of the root of its size, so
that appending to lists costs the root, not the size, for each row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.shared import shared_folder, written

#: Most rows of a group in one array.
CHUNK = 1 << 16

KEY, PLACE, ROW, STATE, EACH = "__key", "__o", "__row", "__st", "__each"

#: From a state (null at first) and an array of rows, in order, to the state after them.
Advance = Callable[[Column, Column], Column]


def bound(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a column that is computed once."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def fold(step: Callable[[Column, Column], Column]) -> Advance:
    return lambda state, rows: F.aggregate(rows, state, step)


def each(step: Callable[[Column, Column], Column], kind: T.DataType) -> Advance:
    """To (state, states after each row)."""
    none = F.array().cast(T.ArrayType(kind))
    pair = lambda state, states: F.struct(state.alias("state"), states.alias("states"))

    def block(acc: Column, x: Column) -> Column:
        return bound(step(acc["state"], x), lambda s: pair(s, F.concat(acc["states"], F.array(s))))

    def run(state: Column, rows: Column) -> Column:
        n = F.size(rows)
        width = F.ceil(F.sqrt(n)).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.greatest(width, F.lit(1)))).otherwise(F.array().cast("array<int>"))

        def more(acc: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(rows, at, width), pair(acc["state"], none), block)
            return bound(inner, lambda t: pair(t["state"], F.concat(acc["states"], t["states"])))

        return F.aggregate(starts, pair(state, none), more)

    return run


def loosened(kind: T.DataType) -> T.DataType:
    """The type with null allowed everywhere, as what columns say of null changes along a fold."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, loosened(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(loosened(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, loosened(kind.valueType))
    return kind


def numbered(df: DataFrame, order: Column) -> tuple[DataFrame, Column]:
    """The rows and a whole number that does not fall along ``order``; where that is none itself, rows are sorted and numbered in a table of their own."""
    kind = df.select(order.alias("o")).schema["o"].dataType
    if kind == T.LongType():
        return df, F.coalesce(order, F.lit(-1))
    if isinstance(kind, T.StructType) and kind.names == ["row", "at"] and kind["row"].dataType == T.LongType():  # rows that a yield has made
        return df, F.coalesce(order["row"], F.lit(-1))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__place", F.monotonically_increasing_id())
    return written(ranged, shared_folder(df.sparkSession)), F.col("__place")


def prefixes(df: DataFrame, order: Column, place: Column, one: Column, kind: T.DataType, identity: Column, compose: Callable[[Column, Column], Column], into: str) -> DataFrame:
    """The rows with the composition of what all rows up to each one do, ``one`` of each, in the order of ``order``.

    ``compose`` is associative.  ``place`` is a whole number that does not fall along the
    order; blocks of 65,536 places are summed up first, then blocks of as many blocks, and so on through
    the 64 bits of a place, so no array has more than 65,536 blocks, however far apart the places lie.  Then
    every block begins with what those before it do.
    """
    kind = loosened(kind)
    rows = df.select(F.shiftright(place, 16).alias("__b"), order.alias(PLACE), one.cast(kind).alias("__f"), F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias(ROW))
    listed = lambda t, key, *more: t.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*more))).alias(ROW + "s"))
    step = lambda acc, x: compose(acc, x["__f"]).cast(kind)
    start = identity.cast(kind)

    def totals(blocks: DataFrame, name: str) -> DataFrame:
        return blocks.select(F.col(name), F.aggregate(ROW + "s", start, step).alias("__f"))

    def before(blocks: DataFrame, first: Column, name: str) -> DataFrame:
        made = bound(each(step, kind)(first, F.col(ROW + "s")), lambda t: F.concat(F.array(first), t["states"]))
        pairs = F.zip_with(ROW + "s", F.slice(made, F.lit(1), F.size(ROW + "s")), lambda x, f: F.struct(x[name].alias(name), f.alias("__before")))
        return blocks.select(F.explode(pairs).alias("__e")).select("__e.*")

    blocks, levels = totals(listed(rows, ["__b"], PLACE, "__f"), "__b"), []
    for _ in range(2):  # blocks of 2**32 and of 2**48 places
        levels.append(listed(blocks.withColumn("__c", F.shiftright("__b", 16)), ["__c"], "__b", "__f"))
        blocks = totals(levels[-1], "__c").withColumnRenamed("__c", "__b")
    starts = before(listed(blocks, [], "__b", "__f"), start, "__b")  # these are at most 65,536
    for level in reversed(levels):
        starts = before(level.join(starts.toDF("__c", "__first"), "__c"), F.col("__first"), "__b")
    whole = listed(rows, ["__b"], PLACE, "__f", ROW).join(starts, "__b")
    made = F.zip_with(ROW + "s", each(step, kind)(F.col("__before"), F.col(ROW + "s"))["states"], lambda x, f: F.struct(x[ROW].alias("row"), f.alias("f")))
    return whole.select(F.explode(made).alias("__e")).select("__e.row.*", F.col("__e.f").alias(into))


@dataclass
class Scan:
    """An ordered fold of each group: ``advance`` gives a state, or with ``row_kind`` a (state, states) of every row."""

    advance: Advance
    kind: T.DataType
    each: bool = False

    def _made(self, state: Column) -> Column:
        return self.advance(state, F.transform(ROW + "s", lambda p: p[ROW]))

    def _run(self, groups: DataFrame, state: Column) -> DataFrame:
        """From (key, rows, start) to (key, state) or (key, state, (row, state of it))."""
        made = groups.withColumn("__made", self._made(state))
        if not self.each:
            return made.withColumn(STATE, F.col("__made")).drop("__made")
        pairs = F.zip_with(ROW + "s", "__made.states", lambda p, s: F.struct(p[ROW].alias("row"), s.alias("state")))
        return made.withColumns({STATE: F.col("__made.state"), EACH: pairs}).drop("__made")

    def over(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        """(key, state) of each group, or (key, row, state) of each row, of rows with ``__key`` and ``__row``."""
        hot = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select(F.col(KEY).alias("__hot"))
        base = shared_folder(rows.sparkSession)
        hot = written(hot, f"{base}/hot")
        on = F.col(KEY).eqNullSafe(F.col("__hot"))
        if hot.isEmpty():
            return self._listed(self._small(rows, order))
        return self._listed(self._small(rows.join(hot, on, "left_anti"), order)).unionByName(self._listed(self._large(rows.join(hot, on, "left_semi"), order, base)))

    def _listed(self, made: DataFrame) -> DataFrame:
        if not self.each:
            return made.select(KEY, STATE)
        return made.select(KEY, F.explode(EACH).alias("__e")).select(KEY, F.col("__e.row").alias(ROW), F.col("__e.state").alias(STATE))

    def _arrays(self, placed: DataFrame, *by: str) -> DataFrame:
        return placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(PLACE, ROW))).alias(ROW + "s"))

    def _small(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        placed = rows.withColumn(PLACE, F.row_number().over(Window.partitionBy(KEY).orderBy(*order)))  # by the same exchange as the groups
        return self._run(self._arrays(placed, KEY), F.lit(None).cast(self.kind))

    def _large(self, rows: DataFrame, order: list[Column], base: str) -> DataFrame:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(n, F.col(KEY), *order).sortWithinPartitions(F.col(KEY), *order)
        placed = written(ranged.withColumn(PLACE, F.monotonically_increasing_id()), f"{base}/placed")  # places rise along the order
        placed = placed.withColumn("__b", F.expr(f"{PLACE} div {CHUNK}"))
        blocks = placed.groupBy(KEY, "__b").agg(F.count(F.lit(1)).alias("n"))
        by_key = Window.partitionBy(KEY)
        rounds = blocks.select(F.col(KEY).alias("__k"), F.col("__b").alias("__c"), F.row_number().over(by_key.orderBy("__b")).alias("__r"), F.max("__b").over(by_key).alias("__last"))
        rounds = written(rounds, f"{base}/rounds")
        same = F.col(KEY).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__c"))
        arrays = self._arrays(placed, KEY, "__b").join(rounds, same).select(KEY, ROW + "s", (F.col("__b") == F.col("__last")).alias("__ends"), "__r")
        written(arrays, f"{base}/arrays", by="__r")
        spark, out, state = rows.sparkSession, [], None
        for r in range(1, rounds.agg(F.max("__r")).first()[0] + 1):
            part = spark.read.schema(arrays.drop("__r").schema).parquet(f"{base}/arrays/__r={r}")
            if state is None:
                part, start = part, F.lit(None).cast(self.kind)
            else:
                part = part.join(state.select(F.col(KEY).alias("__k"), F.col(STATE).alias("__start")), F.col(KEY).eqNullSafe(F.col("__k")), "left").drop("__k")
                start = F.col("__start")
            made = self._run(part, start)
            state = written(made.select(KEY, STATE, "__ends", *([EACH] if self.each else [])), f"{base}/round{r}")
            out.append(state)
        whole = reduce(DataFrame.unionByName, out)
        return whole if self.each else whole.where("__ends")
