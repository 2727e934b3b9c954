"""Typed column values and the truth and comparison rules of the language."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
DECIMAL = T.DecimalType(38, 18)


@dataclass(frozen=True)
class Value:
    """A column and its type, known when the plan is made.

    ``rows`` marks the matches of a lookup: an array that stands for its only
    element where one value is asked for and ``single`` is set.
    """

    col: Column
    type: T.DataType
    rows: bool = False
    single: bool = False
    const: object = None  # what a constant was written as

    def field(self, name: str) -> Value:
        """A member by name; over an array, the members of its elements that are not null."""
        if self.rows and self.single:
            return Value(F.get(self.col, 0), self.type.elementType).field(name)
        if isinstance(self.type, T.StructType):
            if name not in self.type.names:
                return null()
            return Value(self.col[name], self.type[name].dataType).plain()
        if isinstance(self.type, T.MapType):
            return Value(F.try_element_at(self.col, F.lit(name)), self.type.valueType).plain()
        if isinstance(self.type, T.ArrayType):
            inner = Value(F.lit(None), self.type.elementType).field(name).type
            picked = F.transform(self.col, lambda x: Value(x, self.type.elementType).field(name).col)
            return Value(F.filter(picked, lambda x: x.isNotNull()), T.ArrayType(inner))
        parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
        if name in parts and is_time(self.type):
            return Value(parts[name](self.col).cast("long"), LONG)
        return null()

    def plain(self) -> Value:
        """Integers of every width as long, floats as double."""
        wide = widened(self.type)
        return self if wide == self.type else Value(self.col.cast(wide), wide, self.rows, self.single)

    def one(self) -> Value:
        """The value itself; of single lookup matches, the row."""
        return Value(F.get(self.col, 0), self.type.elementType) if self.rows and self.single else self


def widened(t: T.DataType) -> T.DataType:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return LONG
    if isinstance(t, T.FloatType):
        return DOUBLE
    if isinstance(t, (T.CharType, T.VarcharType)):
        return STRING
    return t


def null() -> Value:
    return Value(F.lit(None), NULL)


def literal(x) -> Value:
    """A constant; lists become arrays and dicts structs."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL, const=x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), LONG, const=x)
    if isinstance(x, float):
        return Value(F.lit(x), DOUBLE, const=x)
    if isinstance(x, str):
        return Value(F.lit(x), STRING, const=x)
    if isinstance(x, bytes):
        return Value(F.lit(x), T.BinaryType())
    if isinstance(x, decimal.Decimal):
        return Value(F.lit(x).cast(DECIMAL), DECIMAL)
    if isinstance(x, datetime.datetime):
        return Value(F.lit(x), T.TimestampType())
    if isinstance(x, datetime.date):
        return Value(F.lit(x), T.DateType())
    if isinstance(x, (list, tuple, set)):
        return array([literal(v) for v in x])
    if isinstance(x, dict):
        return struct({k: literal(v) for k, v in x.items()})
    raise TypeError(f"no constant of {type(x)}")


def array(items: list[Value]) -> Value:
    inner = common([v.type for v in items])
    return Value(F.array(*[v.col.cast(inner) for v in items]) if items else F.array().cast(T.ArrayType(STRING)), T.ArrayType(inner if items else STRING))


def struct(fields: dict[str, Value]) -> Value:
    kind = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
    return Value(F.struct(*[v.col.cast(kind[k].dataType).alias(k) for k, v in fields.items()]), kind)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def common(types: list[T.DataType]) -> T.DataType:
    """The type that all can be cast to: numbers widen, anything else next to another type is text."""
    some = [t for t in types if t != NULL]
    if not some:
        return STRING
    first = some[0]
    if all(t == first for t in some):
        return first
    if all(is_number(t) or t == BOOL for t in some):
        return DOUBLE if DOUBLE in some else DECIMAL if any(isinstance(t, T.DecimalType) for t in some) else LONG
    if all(is_time(t) for t in some):
        return next((t for t in some if not isinstance(t, T.DateType)), first)
    if all(isinstance(t, T.ArrayType) for t in some):
        return T.ArrayType(common([t.elementType for t in some]))
    if all(isinstance(t, T.StructType) for t in some):
        names = list(dict.fromkeys(n for t in some for n in t.names))
        if all(t.names == names for t in some):
            return T.StructType([T.StructField(n, common([t[n].dataType for t in some])) for n in names])
    return STRING


def truthy(v: Value) -> Column:
    """False for null, zero, the empty text and the empty container; never null."""
    v = v.one()
    if v.type == NULL:
        return F.lit(False)
    if v.type == BOOL:
        return F.coalesce(v.col, F.lit(False))
    if is_number(v.type):
        return F.coalesce(v.col != 0, F.lit(False))
    if isinstance(v.type, (T.StringType, T.BinaryType)):
        return F.coalesce(F.length(v.col) > 0, F.lit(False))
    if isinstance(v.type, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def flag(c: Column) -> Value:
    return Value(c.cast("long"), LONG)


def compare(op: str, a: Value, b: Value) -> Column:
    """The language's comparison, never null: two falsy values are equal, a falsy one is less than any other."""
    a, b = a.one(), b.one()
    if NULL in (a.type, b.type):
        both, x, y = F.lit(False), None, None
    else:
        kind = a.type if is_number(a.type) and is_number(b.type) is False and b.type == STRING else common([a.type, b.type])
        if is_number(kind) and STRING in (a.type, b.type):
            kind = DOUBLE
        x, y = (v.col.try_cast(kind) if v.type == STRING and is_number(kind) else v.col.cast(kind) for v in (a, b))
        both = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y, "==": x == y, "!=": x != y}[op]
    ta, tb = truthy(a), truthy(b)
    neither = op in (">=", "<=", "==")
    only_a, only_b = op in (">", ">=", "!="), op in ("<", "<=", "!=")
    return F.when(ta & tb, F.coalesce(both, F.lit(op == "!="))).when(~ta & ~tb, F.lit(neither)).when(ta, F.lit(only_a)).otherwise(F.lit(only_b))
