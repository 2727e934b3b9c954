"""The latest earlier row of another table, for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.scan import numbered, prefixes

#: Rows of a key that one task sorts.
HOT = 1 << 22


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = True, ties: list[str] | None = None) -> DataFrame:
    """Both tables in one order of time within ``by``; each left row takes the values of the last right row before it.

    Of right rows at one time the one with the largest ``ties`` is the last; without
    them, the one with the largest values.

    One shuffle of the union, no pairs: work grows with the rows, whatever the
    number of earlier rows of a key.  Where a key has more than HOT rows, the union is sorted over range
    partitions, and each block of rows begins with the last right row of those before it, so no key is one task's.
    """
    marked_left = left.withColumns({"__t": F.col(left_time), "__side": F.lit(0 if strict else 1), "__row": F.struct(*left.columns), "__hit": F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType)})
    marked_right = right.withColumns({"__t": F.col(right_time), "__side": F.lit(1 if strict else 0), "__hit": F.struct(*values), "__tie": F.struct(*(ties or values))}).withColumn("__row", F.lit(None).cast(marked_left.schema["__row"].dataType))
    marked_left = marked_left.withColumn("__tie", F.lit(None).cast(marked_right.schema["__tie"].dataType))
    cols = [*by, "__t", "__side", "__tie", "__row", "__hit"]
    both = marked_left.select(*cols).unionByName(marked_right.select(*cols))
    if both.groupBy(*by).count().where(F.col("count") > HOT).isEmpty():
        w = Window.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("__last", F.last("__hit", ignorenulls=True).over(w))
    else:
        placed, place = numbered(both, F.struct(*by, "__t", "__side", "__tie"))
        one = F.struct(F.struct(*by).alias("key"), F.col("__hit").alias("hit"))
        kind = placed.select(one.alias("x")).schema["x"].dataType

        def compose(f: Column, g: Column) -> Column:
            within = F.when(f["key"].eqNullSafe(g["key"]), F.coalesce(g["hit"], f["hit"])).otherwise(g["hit"])
            return F.when(f.isNull(), g).when(g.isNull(), f).otherwise(F.struct(g["key"].alias("key"), within.alias("hit")))

        found = prefixes(placed, place, place, one, kind, F.lit(None), compose, "__seen").withColumn("__last", F.col("__seen.hit"))
    found = found.where(F.col("__row").isNotNull())
    return found.select("__row.*", *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])
