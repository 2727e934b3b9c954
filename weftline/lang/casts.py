"""The casts, written ``|name argument``: null stays null, a failed number is 0, a failed date is null."""

from __future__ import annotations

import re
from collections.abc import Callable


from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.lang.values import BOOL, DECIMAL, DOUBLE, LONG, NULL, STRING, Value, array, is_number, is_time, truthy, widened

# Strftime letters and Java's date patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "j": "DDD", "A": "EEEE", "a": "EEE", "B": "MMMM", "b": "MMM", "Z": "z", "z": "Z", "%": "%",
}

ZERO_OBJECTID, ZERO_UUID = "0" * 24, "00000000-0000-0000-0000-000000000000"
DATE_FORMATS = ("yyyyMMddHHmmss", "yyyyMMdd")


def date_pattern(fmt: str) -> str:
    """Java's pattern for a strftime format; other text is quoted."""
    out, plain = [], ""
    for m in re.finditer(r"%(.)|([^%]+)", fmt):
        if m[1] is not None and m[1] in STRFTIME:
            if plain:
                out.append("'" + plain.replace("'", "''") + "'" if re.search("[A-Za-z']", plain) else plain)
                plain = ""
            out.append(STRFTIME[m[1]])
        else:
            plain += m[2] or m[0]
    if plain:
        out.append("'" + plain.replace("'", "''") + "'" if re.search("[A-Za-z']", plain) else plain)
    return "".join(out)


def _each(v: Value, one: Callable[[Value], Value]) -> Value | None:
    """A cast of every element, for arrays."""
    if isinstance(v.type, T.ArrayType) and not v.rows:
        kind = one(Value(F.lit(None).cast(v.type.elementType), v.type.elementType)).type
        return Value(F.transform(v.col, lambda x: one(Value(x, v.type.elementType)).col), T.ArrayType(kind))
    return None


def _number(v: Value, kind: T.DataType) -> Value:
    v = v.one()
    whole = kind == LONG
    if v.type == NULL:
        return Value(F.lit(None).cast(kind), kind)
    if (many := _each(v, lambda x: _number(x, kind))) is not None:
        return many
    if v.type == STRING:
        parsed = F.trim(v.col).try_cast(DOUBLE if whole else kind)
        exact = F.trim(v.col).try_cast(kind)
        col = F.when(v.col.isNotNull(), F.coalesce(exact, F.when(F.abs(parsed) < 9e18, parsed.cast(kind)) if whole else parsed, F.lit(0).cast(kind)))
    elif isinstance(v.type, T.TimestampNTZType):
        col = F.unix_timestamp(v.col.cast("timestamp")).cast(kind)
    elif is_time(v.type):
        col = F.unix_timestamp(v.col.cast("timestamp")).cast(kind)
    elif is_number(v.type) or v.type == BOOL:
        col = F.when(v.col.isNotNull(), F.coalesce(v.col.try_cast(kind), F.lit(0).cast(kind)))
    else:
        col = F.when(v.col.isNotNull(), F.lit(0).cast(kind))
    return Value(col, kind)


def to_int(v: Value, arg: str = "") -> Value:
    return _number(v, LONG)


def to_float(v: Value, arg: str = "") -> Value:
    return _number(v, DOUBLE)


def to_decimal(v: Value, arg: str = "") -> Value:
    return _number(v, DECIMAL)


def to_str(v: Value, arg: str = "") -> Value:
    v = v.one()
    if (many := _each(v, lambda x: to_str(x, arg))) is not None:
        return many
    if v.type in (STRING, NULL):
        col = v.col.cast("string")
        if arg and v.type == STRING and "%s" in arg:
            col = F.format_string(arg, col)
    elif v.type == BOOL:
        col = F.when(v.col, "true").when(~v.col, "false")
    elif is_time(v.type):
        usual = "yyyy-MM-dd" if isinstance(v.type, T.DateType) else "yyyy-MM-dd HH:mm:ss"
        col = F.date_format(v.col, date_pattern(arg) if arg else usual)
    elif is_number(v.type):
        whole = v.type == LONG
        col = F.when(v.col.isNotNull(), F.format_string(re.sub(r"%(\d*)[di]", r"%\1d" if whole else r"%\1.0f", arg) if arg else "%d" if whole else "%f", v.col if whole else v.col.cast("double")))
    elif isinstance(v.type, T.BinaryType):
        col = F.decode(v.col, "utf-8")
    elif isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)):
        col = F.to_json(v.col)
    else:
        col = v.col.cast("string")
    return Value(col, STRING)


def to_bytes(v: Value, arg: str = "") -> Value:
    v = v.one()
    if isinstance(v.type, T.BinaryType):
        return v
    text = to_str(v).col
    return Value(F.try_to_binary(text, F.lit("hex")) if arg == "hex" else F.encode(text, arg or "utf-8"), T.BinaryType())


def to_bool(v: Value, arg: str = "") -> Value:
    if (many := _each(v.one(), to_bool)) is not None:
        return many
    return Value(F.when(v.one().col.isNotNull(), truthy(v)), BOOL)


def to_array(v: Value, arg: str = "") -> Value:
    if isinstance(v.type, T.ArrayType):
        return Value(v.col, v.type)
    if isinstance(v.type, T.MapType):
        return Value(F.map_values(v.col), T.ArrayType(v.type.valueType))
    made = array([v])
    return Value(F.when(v.col.isNotNull(), made.col), made.type)


def to_set(v: Value, arg: str = "") -> Value:
    v = to_array(v)
    return Value(F.array_distinct(v.col), v.type)


def to_map(v: Value, arg: str = "") -> Value:
    """A list of rows by one of their fields: rows of each key in order."""
    v = Value(v.col, v.type)
    if isinstance(v.type, (T.MapType, T.StructType)) or not arg:
        return v
    row = v.type.elementType
    key = Value(F.lit(None), row).field(arg).type
    keys = F.array_distinct(F.transform(v.col, lambda r: Value(r, row).field(arg).col))
    kept = F.filter(keys, lambda k: k.isNotNull())
    pairs = F.transform(kept, lambda k: F.struct(k.alias("key"), F.filter(v.col, lambda r: Value(r, row).field(arg).col == k).alias("value")))
    return Value(F.map_from_entries(pairs), T.MapType(key, v.type))


def _identifier(pattern: str, zero: str) -> Callable[[Value, str], Value]:
    def cast(v: Value, arg: str = "") -> Value:
        if (many := _each(v.one(), cast)) is not None:
            return many
        text = F.lower(to_str(v).col)
        return Value(F.when(text.isNotNull(), F.when(F.regexp_like(text, F.lit(pattern)), text).otherwise(zero)), STRING)

    return cast


def to_timestamp(v: Value, arg: str = "") -> Value:
    """A timestamp; numbers are seconds since 1970, text is tried as ISO and as digits, then by the format.

    With a format, a time is cut to what the format shows.
    """
    v = v.one()
    if (many := _each(v, lambda x: to_timestamp(x, arg))) is not None:
        return many
    kind: T.DataType = T.TimestampType()
    if v.type == STRING:
        tries = [v.col.try_cast("timestamp"), *[F.try_to_timestamp(v.col, F.lit(p)) for p in DATE_FORMATS], *([F.try_to_timestamp(v.col, F.lit(date_pattern(arg)))] if arg else [])]
        digits = F.regexp_like(v.col, F.lit("^[0-9]+$"))
        col = F.when(digits & (F.length(v.col) == 14), tries[1]).when(digits & (F.length(v.col) == 8), tries[2]).otherwise(F.coalesce(tries[0], *tries[3:]))
    elif is_number(v.type):
        col = F.timestamp_micros((v.col.cast("double") * 1_000_000).cast("long"))
    elif is_time(v.type):
        col, kind = (v.col, v.type) if not isinstance(v.type, T.DateType) else (v.col.cast("timestamp"), kind)
    else:
        col = F.lit(None).cast("timestamp")
    if arg and is_time(v.type):
        shown = {x for x in re.findall("%(.)", arg)}
        cut = "second" if "S" in shown else "minute" if "M" in shown else "hour" if "H" in shown else "day" if "d" in shown else "month" if "m" in shown else "year"
        if "f" not in shown:
            col = F.date_trunc(cut, col).cast(kind)
    return Value(col, kind)


def to_date(v: Value, arg: str = "") -> Value:
    v = v.one()
    if isinstance(v.type, T.DateType):
        return v
    return Value(to_timestamp(v, arg).col.cast("date"), T.DateType())


def to_time(v: Value, arg: str = "") -> Value:
    """A time of day as text, HH:mm:ss."""
    v = v.one()
    if v.type == STRING:
        hms = F.regexp_extract(v.col, r"^([0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
        digits = F.regexp_replace(F.regexp_extract(v.col, r"^([0-9]{6})$", 1), r"([0-9]{2})([0-9]{2})([0-9]{2})", "$1:$2:$3")
        rest = F.date_format(to_timestamp(v, arg).col, "HH:mm:ss")
        return Value(F.when(hms != "", hms).when(digits != "", digits).otherwise(rest), STRING)
    return Value(F.date_format(to_timestamp(v).col, "HH:mm:ss"), STRING)


CASTS: dict[str, Callable[[Value, str], Value]] = {
    "int": to_int,
    "float": to_float,
    "decimal": to_decimal,
    "str": to_str,
    "bytes": to_bytes,
    "bool": to_bool,
    "array": to_array,
    "set": to_set,
    "map": to_map,
    "objectid": _identifier("^[0-9a-f]{24}$", ZERO_OBJECTID),
    "uuid": _identifier("^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$", ZERO_UUID),
    "datetime": to_timestamp,
    "date": to_date,
    "time": to_time,
}


def register_cast(name: str, fn: Callable[[Value, str], Value]) -> None:
    CASTS[name] = fn


def cast(v: Value, text: str) -> Value:
    """``text`` is the part after the bar: a name and an optional argument."""
    name, _, arg = text.strip().partition(" ")
    if name not in CASTS:
        raise ValueError(f"unknown cast {name!r}")
    return CASTS[name](v, arg.strip())




__all__ = ["CASTS", "cast", "date_pattern", "register_cast", "widened"]
