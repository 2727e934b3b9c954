"""The write modes as joins of the target's rows with the new ones.

Every mode gives the whole table as it is to be afterwards, with ``_change``:
``same``, ``update`` or ``insert``.  Deleted rows are simply not there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _aligned(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target's rows with the source's column types; columns it lacks are null."""
    types = {f.name: f.dataType for f in source.schema}
    cols = [F.col(f"`{n}`").cast(types[n]).alias(n) if n in target.columns else F.lit(None).cast(types[n]).alias(n) for n in source.columns]
    return target.select(*cols, *[F.col(f"`{n}`") for n in target.columns if n not in types])


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the last one."""
    order = F.monotonically_increasing_id()
    rest = [n for n in df.columns if n not in keys]
    row = F.struct(*rest) if rest else F.lit(1)
    picked = df.withColumn("_o", order).groupBy(*keys).agg(F.max_by(row, "_o").alias("_r"))
    return picked.select(*keys, *([F.col(f"_r.`{n}`") for n in rest]))


def _merged(target: DataFrame, source: DataFrame, keys: list[str], neutral: list[str], insert: bool, delete: Callable[[DataFrame], Column] | None) -> DataFrame:
    target = _aligned(target, source)
    names = target.columns
    old = target.select(*[F.col(f"`{n}`").alias(f"o_{n}") for n in names], F.lit(True).alias("_old"))
    new = _last(source, keys).select(*[F.col(f"`{n}`").alias(f"n_{n}") for n in source.columns], F.lit(True).alias("_new"))
    cond = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys]
    whole = cond[0]
    for c in cond[1:]:
        whole = whole & c
    both = old.join(new, whole, "full" if insert else "left")
    changed = F.lit(False)
    for n in source.columns:
        if n not in keys and n not in neutral:
            changed = changed | ~F.col(f"o_{n}").eqNullSafe(F.col(f"n_{n}"))
    had, has = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    change = F.when(~had, "insert").when(has & changed, "update").otherwise("same")
    if delete is not None:
        # the scope speaks of the target's own columns
        both = both.withColumns({n: F.col(f"o_{n}") for n in names})
        within = F.coalesce(delete(both), F.lit(False))
        both = both.where(~(had & ~has & within)).drop(*names)
    take = F.col("_change") != "same"
    both = both.withColumn("_change", change)
    cols = [F.when(take, F.col(f"n_{n}")).otherwise(F.col(f"o_{n}")).alias(n) if n in source.columns else F.col(f"o_{n}").alias(n) for n in names]
    return both.select(*cols, "_change")


def insert(target: DataFrame, source: DataFrame, keys, neutral, scope) -> DataFrame:
    old = _aligned(target, source).withColumn("_change", F.lit("same"))
    return old.unionByName(source.withColumn("_change", F.lit("insert")), allowMissingColumns=True)


def update(target, source, keys, neutral, scope) -> DataFrame:
    return _merged(target, source, keys, neutral, insert=False, delete=None)


def upsert(target, source, keys, neutral, scope) -> DataFrame:
    return _merged(target, source, keys, neutral, insert=True, delete=None)


def sync(target, source, keys, neutral, scope) -> DataFrame:
    """Update, insert, and delete rows within the job's filters that it no longer gives."""
    return _merged(target, source, keys, neutral, insert=True, delete=scope)


def replace(target, source, keys, neutral, scope) -> DataFrame:
    """Delete the rows within the job's filters, then insert all."""
    aligned = _aligned(target, source)
    kept = aligned.where(~F.coalesce(scope(aligned), F.lit(False))).withColumn("_change", F.lit("same"))
    return kept.unionByName(source.withColumn("_change", F.lit("insert")), allowMissingColumns=True)


MERGES = {"insert": insert, "update": update, "upsert": upsert, "sync": sync, "replace": replace}


def apply_mode(mode: str, target: DataFrame, source: DataFrame, keys: list[str], neutral: list[str] | None = None, scope: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The table after writing ``source`` to ``target``.

    A row is updated only if a column that is not neutral differs, null-safe, after
    the target's values have the new rows' types.  Of rows with equal keys the last
    counts.  ``scope`` says which target rows the job answers for; all, if not given.
    """
    if mode != "insert" and mode != "replace" and not keys:
        raise ValueError(f"{mode} needs keys")
    return MERGES[mode](target, source, keys, neutral or [], scope or (lambda df: F.lit(True)))
