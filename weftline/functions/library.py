"""The built-in functions."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.registry import register_function
from weftline.lang import casts
from weftline.lang.values import BOOL, DOUBLE, LONG, NULL, STRING, Value, array, common, compare, flag, is_number, is_time, literal, null, struct, truthy


def constant(v: Value):
    """What a literal was written as; functions take some arguments only so."""
    return v.const


def _mapped(fn):
    """Over an array as first argument, the function of each element."""

    def wide(v: Value, *rest: Value) -> Value:
        v = v.one()
        if isinstance(v.type, T.ArrayType):
            kind = fn(Value(F.lit(None).cast(v.type.elementType), v.type.elementType), *rest).type
            return Value(F.transform(v.col, lambda x: fn(Value(x, v.type.elementType), *rest).col), T.ArrayType(kind))
        return fn(v, *rest)

    return wide


def _text(v: Value) -> Column:
    return casts.to_str(v).col if v.type != STRING else v.one().col


# --- identity and type tests -------------------------------------------------------------------


@register_function("")
def identity(*args: Value) -> Value:
    return args[0] if len(args) == 1 else array(list(args))


register_function("make")(lambda *args: array(list(args)))

# Names of types.
TYPE_NAMES = {"long": "int", "double": "float", "string": "str", "binary": "bytes", "boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "date", "void": "null", "array": "array", "map": "map", "struct": "map", "decimal": "decimal"}


@register_function("type")
@_mapped
def type_name(v: Value) -> Value:
    return Value(F.when(v.col.isNull(), "null").otherwise(TYPE_NAMES.get(v.type.typeName(), v.type.typeName())), STRING)


@register_function("is_null")
def is_null(v: Value) -> Value:
    if isinstance(v.type, T.ArrayType):
        return flag(v.col.isNull() | F.forall(v.col, lambda x: x.isNull()))
    return flag(v.col.isNull())


def _is(test, keep_null: bool = True):
    def fn(v: Value) -> Value:
        if isinstance(v.type, T.ArrayType):
            inner = Value(F.lit(None).cast(v.type.elementType), v.type.elementType)
            return flag(F.lit(bool(test(inner.type))) & F.forall(v.col, lambda x: x.isNotNull()))
        is_it = F.lit(1 if test(v.type) else 0).cast("long")
        return Value(F.when(v.col.isNotNull(), is_it) if keep_null else F.when(v.col.isNotNull(), is_it).otherwise(0), LONG)

    return fn


for _name, _test in {
    "is_int": lambda t: t == LONG,
    "is_float": lambda t: t == DOUBLE,
    "is_decimal": lambda t: isinstance(t, T.DecimalType),
    "is_number": is_number,
    "is_string": lambda t: t == STRING,
    "is_bytes": lambda t: isinstance(t, T.BinaryType),
    "is_map": lambda t: isinstance(t, (T.MapType, T.StructType)),
    "is_datetime": lambda t: isinstance(t, (T.TimestampType, T.TimestampNTZType)),
    "is_date": is_time,
    "is_time": lambda t: False,
}.items():
    register_function(_name)(_is(_test))
register_function("is_bool")(_is(lambda t: t == BOOL, keep_null=False))
register_function("is_array", "is_set")(lambda v: flag(F.lit(isinstance(v.type, T.ArrayType)) & v.col.isNotNull()))
register_function("is_objectid")(lambda v: flag(F.coalesce(F.regexp_like(_text(v), F.lit("^[0-9a-fA-F]{24}$")), F.lit(False))))
register_function("is_uuid")(lambda v: flag(F.coalesce(F.regexp_like(F.lower(_text(v)), F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), F.lit(False))))


@register_function("is")
def same(a: Value, b: Value) -> Value:
    kind = common([a.type, b.type])
    return flag(a.col.cast(kind).eqNullSafe(b.col.cast(kind)))


def _convert(name: str, empty):
    def fn(v: Value, *args: Value) -> Value:
        made = casts.CASTS[name](v, constant(args[0]) if args else "")
        return Value(F.coalesce(made.col, F.lit(empty).cast(made.type) if empty is not None else F.lit(None).cast(made.type)), made.type)

    return fn


for _name, _empty in {"int": 0, "float": 0.0, "decimal": 0, "string": "", "bytes": b"", "bool": False, "objectid": casts.ZERO_OBJECTID, "uuid": casts.ZERO_UUID, "datetime": None, "date": None, "time": None}.items():
    register_function(f"convert_{_name}")(_convert({"string": "str"}.get(_name, _name), _empty))


def _convert_container(name: str):
    def fn(v: Value, *args: Value) -> Value:
        made = casts.CASTS[name](v, constant(args[0]) if args else "")
        empty = F.array().cast(made.type) if isinstance(made.type, T.ArrayType) else F.create_map().cast(made.type) if isinstance(made.type, T.MapType) else None
        return made if empty is None else Value(F.coalesce(made.col, empty), made.type)

    return fn


for _name in ("array", "set", "map"):
    register_function(f"convert_{_name}")(_convert_container(_name))


# --- arithmetic: null is the identity ------------------------------------------------------------


def _pairwise(a: Value, b: Value, one) -> Value:
    """Scalars, a list with a scalar, or two lists padded with null."""
    a, b = a.one(), b.one()
    la, lb = isinstance(a.type, T.ArrayType), isinstance(b.type, T.ArrayType)
    inner = lambda v: Value(F.lit(None).cast(v.type.elementType), v.type.elementType)
    if la and lb:
        kind = one(inner(a), inner(b)).type
        return Value(F.zip_with(a.col, b.col, lambda x, y: one(Value(x, a.type.elementType), Value(y, b.type.elementType)).col), T.ArrayType(kind))
    if la:
        return Value(F.transform(a.col, lambda x: one(Value(x, a.type.elementType), b).col), T.ArrayType(one(inner(a), b).type))
    if lb:
        return Value(F.transform(b.col, lambda y: one(a, Value(y, b.type.elementType)).col), T.ArrayType(one(a, inner(b)).type))
    return one(a, b)


def _arith(both, text=None, left_null=lambda x: x):
    def one(a: Value, b: Value) -> Value:
        if a.type == NULL and b.type == NULL:
            return null()
        if STRING in (a.type, b.type) and a.type in (STRING, NULL) and text is not None:
            x, y = _text(a), _text(b)
            return Value(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(text(x, y)), STRING)
        if a.type == NULL:
            return Value(left_null(b.col), b.type)
        if b.type == NULL:
            return a
        if is_time(a.type) or is_time(b.type):
            a, b = casts.to_int(a), casts.to_int(b)
        if STRING in (a.type, b.type):
            a, b = (casts.to_float(v) if v.type == STRING else v for v in (a, b))
        kind = common([LONG if v.type == BOOL else v.type for v in (a, b)])
        x, y = a.col.cast(kind), b.col.cast(kind)
        made, out = both(x, y, kind)
        return Value(F.when(x.isNull(), left_null(y).cast(out)).when(y.isNull(), x.cast(out)).otherwise(made.cast(out)), out)

    def fn(*args: Value) -> Value:
        return reduce(lambda a, b: _pairwise(a, b, one), args)

    return fn


def _wide(kind: T.DataType) -> T.DataType:
    return T.DecimalType(38, 18) if isinstance(kind, T.DecimalType) else kind


def _divide(x: Column, y: Column, kind):
    out = DOUBLE if kind in (LONG, DOUBLE) else _wide(kind)
    return F.when(y == 0, F.lit(0).cast(out)).otherwise(x.cast(out) / y.cast(out)), out


def _modulo(x: Column, y: Column, kind):
    return F.when(y == 0, F.lit(0).cast(kind)).otherwise((x % y + y) % y), _wide(kind)


register_function("add")(_arith(lambda x, y, k: (x + y, _wide(k)), text=lambda x, y: F.concat(x, y)))
register_function("sub")(_arith(lambda x, y, k: (x - y, _wide(k)), left_null=lambda y: -y))
register_function("mul")(_arith(lambda x, y, k: (x * y, _wide(k))))
register_function("div")(_arith(_divide, left_null=lambda y: -y))
register_function("mod")(_arith(_modulo))


@register_function("bit")
def bit(op: Value, a: Value, *rest: Value) -> Value:
    name, x = constant(op), casts.to_int(a).col
    if name == "~":
        return Value(F.bitwise_not(x), LONG)
    y = casts.to_int(rest[0]).col
    small = y.cast("int")
    made = {">>": lambda: F.call_function("shiftright", x, small), "<<": lambda: F.call_function("shiftleft", x, small), "&": lambda: x.bitwiseAND(y), "|": lambda: x.bitwiseOR(y), "^": lambda: x.bitwiseXOR(y)}[name]()
    return Value(F.when(x.isNotNull() & y.isNotNull(), F.when(y == 0, F.lit(0).cast("long")).otherwise(made)), LONG)


@register_function("neg")
def neg(v: Value) -> Value:
    v = v.one()
    return Value(F.reverse(v.col) if v.type == STRING or isinstance(v.type, T.ArrayType) else -v.col, v.type)


@register_function("not")
@_mapped
def not_(v: Value) -> Value:
    return Value(F.when(v.col.isNotNull(), ~truthy(v)), BOOL)


def _chain(op: str):
    def fn(*args: Value) -> Value:
        if isinstance(args[0].one().type, T.ArrayType) and op not in ("==", "!="):
            return literal(0)
        return flag(reduce(lambda x, y: x & y, [compare(op, a, b) for a, b in zip(args, args[1:], strict=False)]))

    return fn


for _name, _op in {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "neq": "!="}.items():
    register_function(_name)(_chain(_op))


def _value_logic(stop_when_true: bool):
    def fn(*args: Value) -> Value:
        kind = common([a.one().type for a in args])
        cols = [(truthy(a), a.one().col.cast(kind)) for a in args]
        out = cols[-1][1]
        for t, c in reversed(cols[:-1]):
            out = F.when(c.isNull(), out).when(t if stop_when_true else ~t, c).otherwise(F.coalesce(out, c))
        return Value(out, kind)

    return fn


register_function("and")(_value_logic(False))
register_function("or")(_value_logic(True))


def _has(container: Value, x: Value) -> Column:
    c, x = container.one(), x.one()
    if isinstance(c.type, T.ArrayType):
        return F.exists(c.col, lambda e: e.eqNullSafe(x.col.cast(c.type.elementType)))
    if isinstance(c.type, T.MapType):
        return F.map_contains_key(c.col, x.col.cast(c.type.keyType))
    if isinstance(c.type, T.StructType):
        return x.col.isin(c.type.names)
    return F.contains(_text(c), _text(x))


register_function("in")(lambda x, *cs: flag(reduce(lambda p, q: p & q, [F.coalesce(_has(c, x), F.lit(False)) for c in cs])))


@register_function("contain")
def contain(c: Value, x: Value) -> Value:
    return flag(F.coalesce(_has(c, x), F.lit(False)))


@register_function("empty")
def empty(v: Value) -> Value:
    """1 for what is not empty, as the language has it."""
    return Value(F.when(v.one().col.isNotNull(), truthy(v).cast("long")), LONG)


# --- sequences and text --------------------------------------------------------------------------


@register_function("range")
def range_(a: Value, b: Value | None = None, step: Value | None = None) -> Value:
    start, stop = (literal(0), a) if b is None else (a, b)
    by = F.lit(1).cast("long") if step is None else casts.to_int(step).col
    x, y = casts.to_int(start).col, casts.to_int(stop).col
    some = ((by > 0) & (x < y)) | ((by < 0) & (x > y))
    last = F.when(by > 0, y - 1).otherwise(y + 1)
    return Value(F.when(some, F.sequence(x, F.when(some, last).otherwise(x), F.when(some, by).otherwise(F.lit(1).cast("long")))).otherwise(F.array().cast("array<long>")), T.ArrayType(LONG))


def _bounds(n: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    at = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(F.least(start, n))
    end = F.when(stop < 0, F.greatest(n + stop, F.lit(0))).otherwise(F.least(stop, n))
    return at, F.greatest(end - at, F.lit(0))


@register_function("substring")
def substring(s: Value, start: Value, stop: Value | None = None, step: Value | None = None) -> Value:
    """A slice with Python's rules for negative places."""
    s = s.one()
    is_list = isinstance(s.type, T.ArrayType)
    s = s if is_list or s.type == STRING else casts.to_str(s)
    n = F.size(s.col) if is_list else F.length(s.col)
    if stop is None:
        start, stop = literal(0), start
    at, count = _bounds(n, casts.to_int(start).col.cast("int"), casts.to_int(stop).col.cast("int"))
    at, count = at.cast("int"), count.cast("int")
    part = F.slice(s.col, at + 1, count) if is_list else F.substring(s.col, at + 1, count)
    if step is not None:
        by = casts.to_int(step).col.cast("int")
        if is_list:
            part = F.filter(part, lambda x, i: i % by == 0)
        else:
            part = F.array_join(F.filter(F.split(part, ""), lambda x, i: i % by == 0), "")
    return Value(part, s.type)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


@register_function("split")
def split(s: Value, sep: Value) -> Value:
    return Value(F.split(F.coalesce(_text(s), F.lit("")), _quoted(_text(sep)), -1), T.ArrayType(STRING))


@register_function("join")
def join(items: Value, sep: Value) -> Value:
    items = casts.to_array(items)
    texts = F.transform(items.col, lambda x: F.coalesce(casts.to_str(Value(x, items.type.elementType)).col, F.lit("None")))
    return Value(F.coalesce(F.array_join(texts, constant(sep)), F.lit("")), STRING)


@register_function("len")
@_mapped
def length(v: Value) -> Value:
    if isinstance(v.type, (T.ArrayType, T.MapType)):
        return Value(F.size(v.col).cast("long"), LONG)
    return Value(F.length(_text(v)).cast("long"), LONG)


@register_function("abs")
@_mapped
def absolute(v: Value) -> Value:
    v = v if is_number(v.type) else casts.to_float(v)
    return Value(F.coalesce(F.abs(v.col), F.lit(0).cast(v.type)), v.type)


def _extreme(best, many, pick):
    def fn(*args: Value) -> Value:
        first = args[0].one() if not args[0].rows else Value(args[0].col, args[0].type)
        if isinstance(first.type, T.ArrayType):
            if len(args) == 1:
                return Value(many(first.col), first.type.elementType)
            if isinstance(args[1].type, T.MapType):  # what the map has under it
                return Value(F.try_element_at(args[1].col, many(first.col).cast(args[1].type.keyType)), args[1].type.valueType)
            if isinstance(args[1].type, T.StructType):
                text, kind = _text(Value(many(first.col), first.type.elementType)), common([f.dataType for f in args[1].type])
                return Value(F.coalesce(*[F.when(text == n, args[1].col[n].cast(kind)) for n in args[1].type.names]), kind)
            if isinstance(args[1].type, T.ArrayType):  # the member of a parallel list
                place = F.array_position(first.col, many(first.col))
                return Value(F.get(args[1].col, (place - 1).cast("int")), args[1].type.elementType)
            name = constant(args[1])
            row = first.type.elementType
            key = lambda r: Value(r, row).field(name)
            kind = key(F.lit(None).cast(row)).type

            def better(acc: Column, r: Column) -> Column:
                old, new = key(acc).col, key(r).col
                return F.when(new.isNotNull() & (old.isNull() | pick(new, old)), r).otherwise(acc)

            del kind
            return Value(F.aggregate(first.col, F.lit(None).cast(row), better), row)
        kind = common([a.one().type for a in args])
        cols = [a.one().col.cast(kind) for a in args]
        return Value(cols[0] if len(cols) == 1 else best(*cols), kind)

    return fn


register_function("max")(_extreme(F.greatest, F.array_max, lambda new, old: new >= old))
register_function("min")(_extreme(F.least, F.array_min, lambda new, old: new <= old))


def _of(v: Value) -> tuple[Column, T.DataType]:
    made = casts.to_array(v)
    return made.col, made.type.elementType


@register_function("index")
def index(items: Value, x: Value, name: Value | None = None) -> Value:
    if isinstance(items.type, T.MapType):
        return Value(F.try_element_at(items.col, x.col.cast(items.type.keyType)), items.type.valueType)
    found = filter_(items, x, name)
    return Value(F.get(found.col, 0), found.type.elementType)


@register_function("filter")
def filter_(items: Value, x: Value, name: Value | None = None) -> Value:
    col, kind = _of(items)
    if callable(x):
        return Value(F.filter(col, lambda r: truthy(x(Value(r, kind)))), T.ArrayType(kind))
    member = (lambda r: Value(r, kind)) if name is None else (lambda r: Value(r, kind).field(constant(name)))
    return Value(F.filter(col, lambda r: compare("==", member(r), x)), T.ArrayType(kind))


@register_function("sum")
def sum_(items: Value, name: Value | None = None) -> Value:
    col, kind = _of(items)
    member = (lambda r: Value(r, kind)) if name is None else (lambda r: Value(r, kind).field(constant(name)))
    inner = member(F.lit(None).cast(kind)).type
    out = LONG if inner == LONG else DOUBLE
    number = lambda r: F.coalesce(casts._number(member(r), out).col, F.lit(0).cast(out))
    return Value(F.coalesce(F.aggregate(col, F.lit(0).cast(out), lambda acc, r: acc + number(r)), F.lit(0).cast(out)), out)


@register_function("sort")
def sort(items: Value, *args: Value) -> Value:
    """``sort(list)``, ``sort(list, reverse)``, ``sort(list, key)`` or ``sort(list, reverse, key)``; nulls first.

    The key is a field's name or a lambda.
    """
    col, kind = _of(items)
    down = any(a.type in (LONG, BOOL) and str(constant(a)).lower() in ("1", "true") for a in args)
    names = [constant(a) for a in args if a.type == STRING]
    made = next((a for a in args if callable(a)), None)
    key = lambda r: made(Value(r, kind)).col if made else Value(r, kind).field(names[0]).col if names else r

    def order(x: Column, y: Column) -> Column:
        a, b = key(x), key(y)
        up = F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
        return -up if down else up

    return Value(F.array_sort(col, order), T.ArrayType(kind))


# --- time -----------------------------------------------------------------------------------------

_UNITS = {"Y": "year", "m": "month", "d": "day", "H": "hour", "M": "minute", "S": "second", "w": "week"}


@register_function("now")
def now(*args: Value) -> Value:
    """The time when the plan is made, moved by offsets like ``-3d``; numbers then set hour, minute and second."""
    at = F.lit(datetime.datetime.now(datetime.timezone.utc)).cast("timestamp")
    clock: list[int] = []
    for a in args:
        c = constant(a)
        if isinstance(c, str) and (m := re.fullmatch(r"([+-]?\d+)([YmdHMSw])", c)):
            at = at + F.expr(f"INTERVAL {int(m[1])} {_UNITS[m[2]]}")
        elif isinstance(c, str):
            at = F.convert_timezone(None, F.lit(c), at.cast("timestamp_ntz")).cast("timestamp")
        else:
            clock.append(int(c))
    if clock:
        h, mi, s = (clock + [0, 0, 0])[:3]
        at = F.date_trunc("day", at) + F.expr(f"INTERVAL '{h}:{mi}:{s}' HOUR TO SECOND")
    return Value(at, T.TimestampType())


@register_function("time_window")
def time_window(period: Value, at: Value | None = None, offset: Value | None = None, weekday: Value | None = None) -> Value:
    """The start of the window of N days, hours, minutes, seconds or weeks that a time lies in.

    Days count within the month and never fall below its first; the other units
    count within the next larger one, weeks from the first Monday of the year.  A number as offset goes so many windows
    on, of weeks so many back; weeks may start on another weekday, 2 (Tuesday) to 7.
    """
    m = re.fullmatch(r"(\d*)([dHMSw])", constant(period))
    n, unit = int(m[1] or 1), m[2]
    if at is not None and isinstance(at.const, (int, float)) and not isinstance(at.const, bool):
        at, offset = None, at
    v = now() if at is None else at.one() if is_time(at.one().type) else casts.to_timestamp(at)
    c, kind = v.col, v.type
    day = F.date_trunc("day", c).cast(kind)
    if unit == "w":
        week = F.floor((F.dayofyear(c) + 6 - F.weekday(c)) / 7)  # from the first Monday on
        first = constant(weekday) if weekday is not None else None
        start = day - F.make_dt_interval((7 * (week % n)).cast("int"))  # on the same day of the week
        start = start - F.make_dt_interval(F.weekday(c) - F.lit(first - 1 if isinstance(first, int) and 2 <= first <= 7 else 0))
    elif unit == "d":
        start = day - F.make_dt_interval(F.dayofmonth(c) - F.greatest((F.dayofmonth(c) / n).cast("int") * n, F.lit(1)))
    elif unit == "H":
        start = day + F.make_dt_interval(F.lit(0), (F.hour(c) / n).cast("int") * n)
    elif unit == "M":
        start = F.date_trunc("hour", c).cast(kind) + F.make_dt_interval(F.lit(0), F.lit(0), (F.minute(c) / n).cast("int") * n)
    else:
        second = (F.second(c) / n).cast("int") * n
        start = F.date_trunc("minute", c).cast(kind) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    by = constant(offset) if offset is not None else None
    if isinstance(by, (int, float)) and not isinstance(by, bool):
        seconds = {"d": 86400, "H": 3600, "M": 60, "S": 1, "w": -7 * 86400}[unit] * n * by
        start = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    elif offset is not None and (o := re.fullmatch(r"([+-]?\d+)([YmdHMSw])", str(constant(offset)))):
        start = start + F.expr(f"INTERVAL {int(o[1])} {_UNITS[o[2]]}")
    return Value(start.cast(kind), kind)


@register_function("datetime")
def datetime_(method: str, v: Value, *args: Value) -> Value:
    v = v.one() if is_time(v.one().type) else casts.to_timestamp(v)
    c = v.col
    number = {"weekday": lambda: F.weekday(c), "isoweekday": lambda: F.weekday(c) + 1, "timestamp": lambda: F.unix_timestamp(c.cast("timestamp")), "year": lambda: F.year(c), "month": lambda: F.month(c), "day": lambda: F.dayofmonth(c), "hour": lambda: F.hour(c), "minute": lambda: F.minute(c), "second": lambda: F.second(c)}
    if method in number:
        return Value(number[method]().cast("long"), LONG)
    if method == "strftime":
        return casts.to_str(v, constant(args[0]))
    if method == "isoformat":
        return Value(F.date_format(c, "yyyy-MM-dd" if isinstance(v.type, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss"), STRING)
    if method in ("date", "on"):
        return casts.to_date(v)
    if method == "time":
        return casts.to_time(v)
    if method == "startofday":
        return Value(F.date_trunc("day", c).cast(v.type), v.type)
    if method == "at":
        h, m, s = ([casts.to_int(a).col.cast("int") for a in args] + [F.lit(0)] * 3)[:3]
        return Value((F.date_trunc("day", c) + F.make_dt_interval(F.lit(0), h, m, s.cast("decimal(18,6)"))).cast(v.type), v.type)
    if method == "astimezone":
        return Value(F.from_utc_timestamp(F.to_utc_timestamp(c, F.current_timezone()), args[0].col), v.type)
    if method == "replace":
        parts = [F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c)]
        new = [casts.to_int(a).col.cast("int") for a in args] + parts[len(args) :]
        return Value(F.make_timestamp_ntz(*new[:5], F.second(c)).cast(v.type), v.type)
    raise ValueError(f"unknown method datetime::{method}")


# --- families --------------------------------------------------------------------------------------


def _count(s: Column, x: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(x)).cast("long")


def _tabbed(s: Column, size: int) -> Column:
    """Blanks up to the next multiple of ``size`` in place of each tab, counted from the start of its line."""
    parts = F.split(s, "\t", -1)

    def step(acc: Column, part: Column) -> Column:
        at = F.length(F.substring_index(F.concat(acc, part), "\n", -1))
        return F.concat(acc, part, F.repeat(F.lit(" "), F.lit(size) - at % size))

    return F.concat(F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(""), step), F.element_at(parts, -1))


@register_function("string")
def string(method: str, v: Value, *args: Value) -> Value:
    if method == "join":
        return join(args[0], v)
    s, a = _text(v), [x for x in args]
    t = [_text(x) for x in args]
    width = lambda: casts.to_int(a[0]).col.cast("int")
    fill = t[1] if len(t) > 1 else F.lit(" ")
    first, rest = F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.lit(2**31 - 1)))
    tests = {"isalpha": r"^\p{L}+$", "isdigit": r"^\p{Nd}+$", "isdecimal": r"^\p{Nd}+$", "isnumeric": r"^\p{N}+$", "isalnum": r"^[\p{L}\p{N}]+$", "isspace": r"^\s+$", "isascii": r"^\p{ASCII}*$", "isidentifier": r"^[\p{L}_][\p{L}\p{N}_]*$", "isprintable": r"^[^\p{C}\n\r\t]*$"}
    if method in tests:
        return Value(F.regexp_like(s, F.lit(tests[method])), BOOL)
    if method in ("isupper", "islower"):
        change, other = (F.upper, F.lower) if method == "isupper" else (F.lower, F.upper)
        return Value((change(s) == s) & (other(s) != s), BOOL)
    if method == "istitle":
        return Value((F.initcap(s) == s) & F.regexp_like(s, F.lit(r"\p{L}")), BOOL)
    texts = {
        "lower": lambda: F.lower(s), "upper": lambda: F.upper(s), "casefold": lambda: F.lower(s), "capitalize": lambda: F.concat(first, rest), "title": lambda: F.initcap(s),
        "swapcase": lambda: F.array_join(F.transform(F.split(s, ""), lambda x: F.when(F.upper(x) == x, F.lower(x)).otherwise(F.upper(x))), ""),
        "strip": lambda: F.btrim(s, t[0]) if t else F.trim(s), "lstrip": lambda: F.ltrim(s, t[0]) if t else F.ltrim(s), "rstrip": lambda: F.rtrim(s, t[0]) if t else F.rtrim(s),
        "ljust": lambda: F.concat(s, F.repeat(fill, F.greatest(width() - F.length(s), F.lit(0)))), "rjust": lambda: F.concat(F.repeat(fill, F.greatest(width() - F.length(s), F.lit(0))), s),
        "zfill": lambda: F.when(F.regexp_like(s, F.lit("^[+-]")), F.concat(F.substring(s, 1, 1), F.repeat(F.lit("0"), F.greatest(width() - F.length(s), F.lit(0))), F.substring(s, F.lit(2), F.length(s)))).otherwise(F.concat(F.repeat(F.lit("0"), F.greatest(width() - F.length(s), F.lit(0))), s)),
        "expandtabs": lambda: _tabbed(s, int(constant(a[0])) if a else 8), "replace": lambda: F.replace(s, t[0], t[1]), "translate": lambda: F.translate(s, constant(a[0]), constant(a[1])),
        "removeprefix": lambda: F.when(F.startswith(s, t[0]), F.substring(s, F.length(t[0]) + 1, F.length(s))).otherwise(s), "removesuffix": lambda: F.when(F.endswith(s, t[0]), F.substring(s, F.lit(1), F.length(s) - F.length(t[0]))).otherwise(s),
        "format": lambda: F.format_string(re.sub(r"\{[^}]*\}", "%s", constant(v)), *t),
    }
    if method in texts:
        return Value(texts[method](), STRING)
    if method == "center":
        pad = F.greatest(width() - F.length(s), F.lit(0))
        left = (pad / 2).cast("int") + (pad.bitwiseAND(width()).bitwiseAND(F.lit(1)))
        return Value(F.concat(F.repeat(fill, left), s, F.repeat(fill, pad - left)), STRING)
    start = int(constant(a[1])) + 1 if len(a) > 1 else 1
    numbers = {"find": lambda: F.locate(constant(a[0]), s, start) - 1, "index": lambda: F.locate(constant(a[0]), s, start) - 1, "count": lambda: _count(s, t[0]), "rfind": lambda: F.when(F.contains(s, t[0]), F.length(s) - F.length(t[0]) - F.call_function("locate", F.reverse(t[0]), F.reverse(s)) + 1).otherwise(-1)}
    numbers["rindex"] = numbers["rfind"]
    if method in numbers:
        return Value(numbers[method]().cast("long"), LONG)
    if method in ("startswith", "endswith", "contains"):
        return Value({"startswith": F.startswith, "endswith": F.endswith, "contains": F.contains}[method](s, t[0]), BOOL)
    if method in ("split", "rsplit"):
        most = int(constant(a[1])) if len(a) > 1 else -1
        if not t or a[0].type == NULL:
            words = F.split(F.trim(s), r"\s+", most + 1 if most >= 0 and method == "split" else -1)
            return Value(F.filter(words, lambda x: x != ""), T.ArrayType(STRING))
        if method == "split" or most < 0:
            return Value(F.split(s, _quoted(t[0]), most + 1 if most >= 0 else -1), T.ArrayType(STRING))
        back = F.split(F.reverse(s), _quoted(F.reverse(t[0])), most + 1)
        return Value(F.transform(F.reverse(back), lambda x: F.reverse(x)), T.ArrayType(STRING))
    if method == "splitlines":
        return Value(F.split(F.regexp_replace(s, r"\r?\n$", ""), r"\r?\n"), T.ArrayType(STRING))
    if method in ("partition", "rpartition"):
        sep = constant(a[0])
        has = F.contains(s, t[0])
        head = F.substring_index(s, sep, 1) if method == "partition" else F.substring(s, F.lit(1), F.length(s) - F.length(F.substring_index(s, sep, -1)) - len(sep))
        tail = F.substring(s, F.length(head) + len(sep) + 1, F.length(s))
        missing = F.array(s, F.lit(""), F.lit("")) if method == "partition" else F.array(F.lit(""), F.lit(""), s)
        return Value(F.when(has, F.array(head, t[0], tail)).otherwise(missing), T.ArrayType(STRING))
    if method == "encode":
        return casts.to_bytes(v)
    raise ValueError(f"unknown method string::{method}")


@register_function("array")
def array_(method: str, v: Value, *args: Value) -> Value:
    col, kind = _of(v)
    me = Value(col, T.ArrayType(kind))
    if method in ("sum", "max", "min"):
        return {"sum": sum_, "max": _extreme(F.greatest, F.array_max, lambda n, o: n >= o), "min": _extreme(F.least, F.array_min, lambda n, o: n <= o)}[method](me, *args)
    if method == "avg":
        return Value(F.when(F.size(col) > 0, sum_(me, *args).col.cast("double") / F.size(col)).otherwise(0.0), DOUBLE)
    if method in ("first", "last", "pop"):
        return Value(F.get(col, 0) if method == "first" else F.get(col, F.size(col) - 1), kind)
    if method == "slice":
        return substring(me, *args)
    if method in ("gt", "gte", "lt", "lte", "eq", "neq"):
        op = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "neq": "!="}[method]
        return Value(F.filter(col, lambda x: compare(op, Value(x, kind), args[0])), me.type)
    x = args[0].col.cast(kind) if args and not isinstance(args[0].type, T.ArrayType) and method not in ("map", "join", "insert") else None
    if method == "index":
        return Value((F.array_position(col, x) - 1).cast("long"), LONG)
    if method == "count":
        return Value(F.size(F.filter(col, lambda e: e == x)).cast("long"), LONG)
    if method == "contains":
        return flag(F.array_contains(col, x))
    if method == "join":
        return join(me, args[0])
    if method == "map":
        return casts.to_map(me, constant(args[0]))
    if method == "flat":
        return Value(F.flatten(col), kind)
    made = {
        "append": lambda: F.array_append(col, x), "extend": lambda: F.concat(col, args[0].col.cast(me.type)), "insert": lambda: F.array_insert(col, casts.to_int(args[0]).col.cast("int") + 1, args[1].col.cast(kind)),
        "reverse": lambda: F.reverse(col), "sort": lambda: F.array_sort(col), "clear": lambda: F.slice(col, 1, 0), "copy": lambda: col,
        "remove": lambda: F.filter(col, lambda e, i: ~((e == x) & (i + 1 == F.array_position(col, x)))),
    }
    if method not in made:
        raise ValueError(f"unknown method array::{method}")
    return Value(made[method](), me.type)


@register_function("map")
def map_(method: str, v: Value, *args: Value) -> Value:
    v = v.one()
    if isinstance(v.type, T.StructType):
        inner = common([f.dataType for f in v.type])
        v = Value(F.create_map(*[x for n in v.type.names for x in (F.lit(n), v.col[n].cast(inner))]), T.MapType(STRING, inner))
    key, val = v.type.keyType, v.type.valueType
    at = lambda: F.try_element_at(v.col, args[0].col.cast(key))
    if method in ("get", "pop", "setdefault"):
        return Value(F.coalesce(at(), args[1].col.cast(val)) if len(args) > 1 else at(), val)
    if method == "keys":
        return Value(F.map_keys(v.col), T.ArrayType(key))
    if method == "values":
        return Value(F.map_values(v.col), T.ArrayType(val))
    if method == "items":
        return Value(F.map_entries(v.col), T.ArrayType(T.StructType([T.StructField("key", key), T.StructField("value", val)])))
    if method == "contains":
        return flag(F.map_contains_key(v.col, args[0].col.cast(key)))
    if method == "update":
        other = args[0].col.cast(v.type)
        return Value(F.map_concat(F.map_filter(v.col, lambda k, _: ~F.map_contains_key(other, k)), other), v.type)
    if method == "clear":
        return Value(F.map_filter(v.col, lambda k, _: F.lit(False)), v.type)
    if method == "copy":
        return v
    raise ValueError(f"unknown method map::{method}")


@register_function("math")
def math_(method: str, v: Value, *args: Value) -> Value:
    """Errors and undefined results are 0."""

    @_mapped
    def one(v: Value, *rest: Value) -> Value:
        x = casts.to_float(v).col
        y = casts.to_float(rest[0]).col if rest else None
        whole = {"floor": F.floor, "ceil": F.ceil, "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "factorial": lambda c: F.factorial(c.cast("int")), "isnan": lambda c: F.isnan(c).cast("long")}
        if method in whole:
            return Value(F.coalesce(whole[method](x).cast("long"), F.lit(0).cast("long")), LONG)
        if method in ("comb", "perm"):
            n_, k_ = casts.to_int(v).col, casts.to_int(rest[0]).col if rest else casts.to_int(v).col
            fits = (k_ >= 0) & (k_ <= n_)
            k_ = F.when(fits, F.least(k_, n_ - k_) if method == "comb" else k_).otherwise(F.lit(0).cast("long"))
            wide = lambda c: c.cast("decimal(38,0)")
            step = lambda acc, i: wide(F.floor(wide(acc) * wide(n_ - k_ + i) / (wide(i) if method == "comb" else F.lit(1))))
            made = F.aggregate(F.when(k_ > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k_, F.lit(1)))).otherwise(F.array().cast("array<long>")), wide(F.lit(1)), step)
            return Value(F.when(fits, made.cast("long")).otherwise(F.lit(0).cast("long")), LONG)
        if method in ("isinf", "isfinite"):
            infinite = F.abs(x) == float("inf")
            return Value(F.coalesce((infinite if method == "isinf" else ~infinite & ~F.isnan(x)).cast("long"), F.lit(0).cast("long")), LONG)
        if method == "isqrt":
            return Value(F.coalesce(F.when(x >= 0, F.floor(F.sqrt(x))).cast("long"), F.lit(0).cast("long")), LONG)
        if method == "lcm":
            a, b = F.abs(casts.to_int(v).col), F.abs(casts.to_int(rest[0]).col)
            shared = math_("gcd", v, rest[0]).col
            return Value(F.when(shared == 0, 0).otherwise(F.expr("1L") * a / shared * b).cast("long"), LONG)
        if method == "gcd":
            a, b = F.abs(casts.to_int(v).col), F.abs(casts.to_int(rest[0]).col)
            pair = F.struct(a.alias("a"), b.alias("b"))
            step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % F.when(p["b"] == 0, 1).otherwise(p["b"])).alias("b")))
            return Value(F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["a"], LONG)
        plain = {"fabs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log2": F.log2, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "degrees": F.degrees, "radians": F.radians, "expm1": F.expm1, "log1p": F.log1p, "cbrt": F.cbrt, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "exp2": lambda c: F.pow(F.lit(2.0), c)}
        if method in plain:
            made = plain[method](x)
        elif method == "log":
            made = F.log(x) if y is None else F.log(x) / F.log(y)
        elif method in ("pow", "atan2", "hypot", "fmod", "copysign", "remainder"):
            made = {"copysign": lambda a, b: F.when(b < 0, -F.abs(a)).otherwise(F.abs(a)), "remainder": lambda a, b: F.when(b != 0, a - b * F.bround(a / b)), "pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "fmod": lambda a, b: F.when(b != 0, a % b)}[method](x, y)
        else:
            raise ValueError(f"unknown method math::{method}")
        return Value(F.when(made.isNull() | F.isnan(made), 0.0).otherwise(made), DOUBLE)

    return one(v, *args)


@register_function("hash")
def hash_(method: str, *args: Value) -> Value:
    c = F.concat(*[F.coalesce(_text(a), F.lit("None")) for a in args])
    made = {"md5": lambda: F.md5(c), "sha1": lambda: F.sha1(c), "sha256": lambda: F.sha2(c, 256), "sha384": lambda: F.sha2(c, 384), "sha512": lambda: F.sha2(c, 512)}
    return Value(made[method](), STRING)


@register_function("json")
def json_(method: str, v: Value, schema: Value | None = None) -> Value:
    """``json::decode`` takes a type as text, and else gives a map of texts."""
    if method == "encode":
        v = v.one()
        return Value(F.to_json(v.col) if isinstance(v.type, (T.StructType, T.MapType, T.ArrayType)) else _text(v), STRING)
    kind = T.StructType.fromDDL(f"x {constant(schema)}")["x"].dataType if schema is not None else T.MapType(STRING, STRING)
    return Value(F.from_json(_text(v), kind), kind)


@dataclass(frozen=True)
class Match(Value):
    """The text that a pattern has matched, with what its methods need."""

    pattern: str = ""
    text: Column | None = None


def _match_method(method: str, m: Match, *args: Value) -> Value:
    count = len(re.findall(r"(?<!\\)\((?!\?)", m.pattern))
    hit = m.col.isNotNull()
    group = lambda i: F.when(hit, F.regexp_extract(m.text, m.pattern, i))
    start = F.when(hit, (F.regexp_instr(m.text, F.lit(m.pattern)) - 1).cast("long"))
    end = start + F.length(m.col)
    if method == "group":
        wanted = [int(constant(a)) for a in args] or [0]
        return Value(group(wanted[0]), STRING) if len(wanted) == 1 else array([Value(group(i), STRING) for i in wanted])
    if method == "groups":
        return Value(F.when(hit, F.array(*[F.regexp_extract(m.text, m.pattern, i) for i in range(1, count + 1)]).cast("array<string>")), T.ArrayType(STRING))
    if method in ("start", "end"):
        return Value(start if method == "start" else end, LONG)
    if method == "span":
        return Value(F.when(hit, F.array(start, end)), T.ArrayType(LONG))
    raise ValueError(f"unknown method re::{method} of a match")


@register_function("re")
def re_(method: str, pattern: Value, *rest: Value) -> Value:
    if isinstance(pattern, Match):
        return _match_method(method, pattern, *rest)
    s, *args = rest
    p, c = "(?s)" + constant(pattern), _text(s)
    if method in ("match", "search", "fullmatch"):
        full = {"match": f"^(?:{p})", "search": p, "fullmatch": f"^(?:{p})$"}[method]
        group = int(constant(args[0])) if args else 0
        found = F.when(F.regexp_like(c, F.lit(full)), F.regexp_extract(c, full, group))
        return Value(found, STRING) if args else Match(found, STRING, pattern=full, text=c)
    if method in ("findall", "finditer"):
        groups = len(re.findall(r"(?<!\\)\((?!\?)", p))
        if groups > 1:  # each match is the list of its groups
            each = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(p), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)])
            return Value(F.transform(each, lambda m: F.array(*[m[f"g{g}"] for g in range(1, groups + 1)])), T.ArrayType(T.ArrayType(STRING)))
        return Value(F.regexp_extract_all(c, F.lit(p), F.lit(1 if groups else 0)), T.ArrayType(STRING))
    if method == "split":
        return Value(F.split(c, p, -1), T.ArrayType(STRING))
    if method in ("sub", "subn"):  # pattern, replacement, text
        new, text = _text(s), _text(args[0])
        made = F.regexp_replace(text, F.lit(p), F.regexp_replace(new, r"\\(\d)", r"\$$1"))
        if method == "sub":
            return Value(made, STRING)
        return struct({"text": Value(made, STRING), "count": Value(F.regexp_count(text, F.lit(p)).cast("long"), LONG)})
    raise ValueError(f"unknown method re::{method}")


@register_function("random")
def random_(method: str = "", *args: Value) -> Value:
    n = lambda: F.lit(int(constant(args[0])) if args else 8)
    pick = lambda letters: Value(F.array_join(F.transform(F.sequence(F.lit(1), n()), lambda i: F.substring(F.lit(letters), (F.rand() * len(letters)).cast("int") + 1, F.lit(1))), ""), STRING)
    if method in ("", "random"):
        return Value(F.rand(), DOUBLE)
    if method == "int":
        low, high = (casts.to_int(a).col for a in args[:2])
        return Value((low + F.floor(F.rand() * (high - low + 1))).cast("long"), LONG)
    if method in ("string", "letters", "digits", "hexs", "prints"):
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return pick({"string": letters + "0123456789", "letters": letters, "digits": "0123456789", "hexs": "0123456789abcdef", "prints": letters + "0123456789!#$%&()*+,-./:;<=>?@"}[method])
    if method == "bytes":
        return casts.to_bytes(pick("0123456789abcdef"))
    if method == "choice":
        col, kind = _of(args[0])
        return Value(F.get(col, (F.rand() * F.size(col)).cast("int")), kind)
    if method == "choices":
        col, kind = _of(args[0])
        n = casts.to_int(args[1]).col if len(args) > 1 else F.lit(1)
        drawn = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")), lambda _: F.get(col, (F.rand() * F.size(col)).cast("int")))
        return Value(F.when((n > 0) & (F.size(col) > 0), drawn).otherwise(F.array().cast(T.ArrayType(kind))), T.ArrayType(kind))
    if method == "seed":
        return null()
    raise ValueError(f"unknown method random::{method}")


@register_function("uuid")
def uuid_(*args: Value) -> Value:
    return casts.CASTS["uuid"](args[0], "") if args else Value(F.uuid(), STRING)


@register_function("objectid")
def objectid(*args: Value) -> Value:
    """Seconds in hex, then random digits."""
    if args:
        return casts.CASTS["objectid"](args[0], "")
    return Value(F.lower(F.concat(F.lpad(F.hex(F.unix_timestamp()), 8, "0"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 16))), STRING)


@register_function("snowflakeid")
def snowflake(epoch: Value | None = None, datacenter: Value | None = None, worker: Value | None = None) -> Value:
    """Milliseconds since the epoch, then 5 bits of datacenter and 5 of worker, then 12 bits that count rows.

    Without datacenter and worker these ten bits are the partition's number.  Every
    4096 rows of a partition count as one millisecond, and partitions that share the
    ten bits lie 2**20 milliseconds apart, so no two rows of a plan have one id.
    """
    since = int(constant(epoch)) if epoch is not None else 0
    row = F.monotonically_increasing_id()
    part, within = F.shiftright(row, 33), row.bitwiseAND(F.lit(0x1FFFFFFFF))
    if datacenter is None and worker is None:
        place, block = part % 1024, F.floor(part / 1024)
    else:
        given = [int(constant(v)) if v is not None else 0 for v in (datacenter, worker)]
        if not all(0 <= g < 32 for g in given):
            raise ValueError("datacenter and worker are from 0 to 31")
        place, block = F.lit(given[0] * 32 + given[1]), part
    time = F.unix_millis(F.current_timestamp()) - since + block * (1 << 20) + F.shiftright(within, 12)
    return Value(F.shiftleft(time.cast("long"), 22) + place.cast("long") * 4096 + within.bitwiseAND(F.lit(0xFFF)), LONG)


@register_function("struct")
def struct_(method: str, fmt: Value, v: Value) -> Value:
    import pandas as pd

    pattern = constant(fmt)

    def pack(values: pd.Series) -> pd.Series:
        import struct as binary

        return values.map(lambda x: None if x is None or x != x else binary.pack(pattern, int(x) if pattern[-1].lower() in "bhilq" else x))

    if method != "pack":
        raise ValueError("struct:: has pack")
    return Value(F.pandas_udf(pack, "binary")(v.one().col), T.BinaryType())


@register_function("textline")
def textline(method: str, v: Value, *args: Value) -> Value:
    """``textline::split(line, sep)``: fields parted outside quotes and brackets, as a list."""
    sep = re.escape(constant(args[-1]) or " ") if args else r"\s"
    field = rf'"(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^{sep}]+'
    found = F.regexp_extract_all(_text(v), F.lit(f"({field})"), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r'^["\[]|["\]]$', ""))
    return Value(bare, T.ArrayType(STRING))
