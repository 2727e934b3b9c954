"""Grouped folds and window folds as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.registry import FOLDS
from weftline.lang.values import LONG, NULL, Value, literal, struct
from weftline.plans import scan
from weftline.plans.compiler import SEQ, Fold, Windowed


def fold_column(fold: Fold, name: str) -> tuple[Column, T.DataType]:
    """The aggregate of a fold within its groups, in order of arrival where that matters."""
    v = fold.value.one()
    col = v.col if fold.when is None else F.when(fold.when, v.col)
    if fold.kind == "sum":
        return F.sum(col), v.type
    if fold.kind in ("max", "min"):
        return (F.max if fold.kind == "max" else F.min)(col), v.type
    if fold.kind == "list":  # the list itself is asked for
        pairs = F.array_sort(F.collect_list(F.struct(F.col(SEQ).alias("o"), col.alias("v"))))
        return F.transform(pairs, lambda p: p["v"]), T.ArrayType(v.type)
    order = F.col(SEQ) if fold.when is None else F.when(fold.when, F.col(SEQ))
    return F.max_by(v.col, order), v.type


def is_ordered(fold: Fold) -> bool:
    """Whether a fold has no form as an aggregate: its rows go through the step one after the other."""
    return fold.kind == "steps" or fold.kind.startswith("udaf:")


def _step(fold: Fold, name: str, kind: T.DataType):
    def step(acc: Column, r: Column) -> Column:
        return fold.step(Value(acc, kind), Value(r[name], fold.scopes.type)).one().col.cast(kind)

    return step


def ordered_folds(df: DataFrame, key: Column, folds: dict[str, Fold]) -> DataFrame:
    """``__key`` and the value of each fold of its group, rows taken in order of arrival."""
    rows, kinds, advances = {}, {}, {}
    for name, fold in folds.items():
        if fold.kind == "steps":
            row = fold.scopes.type
            kind = fold.step(Value(F.lit(None), NULL), Value(F.lit(None).cast(row), row)).one().type
            kind = fold.step(Value(F.lit(None).cast(kind), kind), Value(F.lit(None).cast(row), row)).one().type

            rows[name], kinds[name], advances[name] = fold.scopes.col, kind, scan.fold(_step(fold, name, kind))
        else:
            fn, kinds[name] = FOLDS[fold.kind.removeprefix("udaf:")]
            rows[name] = fold.value.one().col
            advances[name] = lambda state, rs, fn=fn, name=name: fn(state, F.transform(rs, lambda r: r[name]))
    kind = T.StructType([T.StructField(n, k) for n, k in kinds.items()])

    def advance(state: Column, rs: Column) -> Column:
        return F.struct(*[fn(state[n], rs).alias(n) for n, fn in advances.items()])

    keyed = df.select(key.alias(scan.KEY), F.col(SEQ), F.struct(*[c.alias(n) for n, c in rows.items()]).alias(scan.ROW))
    made = scan.Scan(advance, kind).over(keyed, [F.col(SEQ)])
    return made.select(scan.KEY, *[F.col(f"{scan.STATE}.`{n}`").alias(n) for n in folds])


def window_column(w: Windowed, arrival: Column) -> Value:
    """The value of a window fold over the rows as they are."""
    orders = [(v.one().col.desc() if down else v.one().col.asc()) for v, down in w.order] + [arrival]
    part = Window.partitionBy(w.key.col)
    running = part.orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    ranked = part.orderBy(*orders[:-1]) if w.order else part.orderBy(arrival)
    frame = running if w.ordered else part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, (kind, _, arg) = w.value, w.kind.partition(":")
    n = int(arg or 1)
    if kind in ("sum", "max", "min"):
        made = Value(getattr(F, kind)(v.col).over(frame), v.type)
    elif kind == "count":
        made = Value(F.count(F.lit(1)).over(frame), LONG)
    elif kind == "last":
        made = Value(F.last(v.col).over(running if w.ordered else part.orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), v.type)
    elif kind == "first":
        made = Value(F.first(v.col).over(running), v.type)
    elif kind == "row_number":
        made = Value(F.row_number().over(part.orderBy(*orders)).cast("long"), LONG)
    elif kind in ("rank", "dense_rank"):
        made = Value(getattr(F, kind)().over(ranked).cast("long"), LONG)
    elif kind in ("percent_rank", "cume_dist"):
        made = Value(getattr(F, kind)().over(ranked), T.DoubleType())
    elif kind == "ntile":
        made = Value(F.ntile(n).over(part.orderBy(*orders)).cast("long"), LONG)
    elif kind in ("lag", "lead"):
        made = Value(getattr(F, kind)(v.col, n).over(part.orderBy(*orders)), v.type)
    else:
        raise ValueError("a window's own step is no column; see window_states")
    return w.ret(made)


def window_states(df: DataFrame, w: Windowed, name: str, arrival: Column) -> tuple[DataFrame, Value]:
    """The rows with the state of a window's own step as a column, and its value: after each row, or without an order after all."""
    own = [n for n in df.columns if n != SEQ and not n.startswith("__")]
    data = T.StructType([T.StructField(n, df.schema[n].dataType) for n in own])
    order = w.order[0][0].one() if w.order else literal(None)
    blank = lambda t: Value(F.lit(None).cast(t), t)
    out = w.step(_context(w.value, blank(w.value.type), data=blank(data))).one().type
    out = w.step(_context(w.value, blank(out), data=blank(data))).one().type
    kind = T.StructType([T.StructField("s", out), T.StructField("n", LONG)])

    def step(acc: Column, x: Column) -> Column:
        n = F.coalesce(acc["n"], F.lit(0).cast("long"))
        row = Value(F.struct(*[x["r"][n].alias(n) for n in own]), data)
        made = w.step(_context(Value(x["v"], w.value.type), Value(acc["s"], out), Value(n, LONG), Value(x["o"], order.type), row))
        return F.struct(made.one().col.cast(out).alias("s"), (n + 1).alias("n"))

    sorts = {f"__sort{i}": (v.one().col, down) for i, (v, down) in enumerate(w.order)} | {f"__sort{len(w.order)}": (arrival, False)}
    row = F.struct(F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("r"), w.value.col.alias("v"), order.col.alias("o"))
    keyed = df.select(w.key.col.alias(scan.KEY), *[c.alias(n) for n, (c, _) in sorts.items()], row.alias(scan.ROW))
    orders = [F.desc(n) if down else F.asc(n) for n, (_, down) in sorts.items()]
    if w.ordered:
        made = scan.Scan(scan.each(step, kind), kind, each=True).over(keyed, orders)
        return made.select(f"{scan.ROW}.r.*", F.col(f"{scan.STATE}.s").alias(name)), Value(F.col(name), out)
    made = scan.Scan(scan.fold(step), kind).over(keyed, orders).select(F.col(scan.KEY).alias(f"{name}k"), F.col(f"{scan.STATE}.s").alias(name))
    return df.join(made, w.key.col.eqNullSafe(F.col(f"{name}k")), "left").drop(f"{name}k"), Value(F.col(name), out)


def _context(value: Value, state: Value, index: Value | None = None, order: Value | None = None, data: Value | None = None) -> Value:
    """What a window's step sees: the row's value, the state so far, the row, its place and its order's value."""
    row = {"current_index": index or literal(0), "current_value": value, "order_value": order or literal(None)} | ({} if data is None else {"current_data": data})
    return struct({"value": value, "state": state, "context": struct(row)})


def with_arrival(df: DataFrame, column: str | None) -> DataFrame:
    """Adds the order of arrival: a declared column, or the order in which the rows lie in their files."""
    return df.withColumn(SEQ, F.col(f"`{column}`") if column else F.monotonically_increasing_id())
