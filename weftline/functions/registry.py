"""The registry: a function takes typed values and gives a typed value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.lang.values import Value, null

FUNCTIONS: dict[str, Callable[..., Value]] = {}
FOLDS: dict[str, tuple[Callable, T.DataType]] = {}


def register_function(*names: str):
    """Register a builder of columns under one or more names."""

    def add(fn):
        for name in names:
            FUNCTIONS[name] = fn
        return fn

    return add


def register_udf(name: str, fn: Callable, return_type: T.DataType | str, vectorised: bool = True) -> None:
    """Register Python code: a function of pandas Series, or of single values.

    Single-value functions give null where they raise.
    """
    if isinstance(return_type, str):
        return_type = T.StructType.fromDDL(f"x {return_type}")["x"].dataType
    if vectorised:
        udf = F.pandas_udf(fn, return_type, F.PandasUDFType.SCALAR)
    else:

        def quiet(*args):
            try:
                return fn(*args)
            except Exception:
                return None

        udf = F.udf(quiet, return_type)
    FUNCTIONS[name] = lambda *args: Value(udf(*[a.one().col for a in args]), return_type)


def register_fold(name: str, fn: Callable, return_type: T.DataType | str) -> None:
    """Register Python code as a fold: a function of the state so far, None at first, and a value.

    ``["#aggregate", key, ["@name", "$.field", value]]`` folds each group's values in order
    of arrival; a large group comes in several arrays, each with the state that the one before has left.
    """
    if isinstance(return_type, str):
        return_type = T.StructType.fromDDL(f"x {return_type}")["x"].dataType

    @F.pandas_udf(return_type)
    def folded(states: pd.Series, groups: pd.Series) -> pd.Series:
        known = [None if pd.api.types.is_scalar(s) and pd.isna(s) else s for s in states]
        return pd.Series([reduce(fn, values, state) for state, values in zip(known, groups, strict=True)], dtype=object)

    FOLDS[name] = (folded, return_type)


def call(name: str, args: list[Value]) -> Value:
    from weftline.functions import library  # noqa: F401  registers the built-in functions

    if name in FUNCTIONS:
        return FUNCTIONS[name](*args)
    family, _, method = name.partition("::")
    if method and family in FUNCTIONS:
        return FUNCTIONS[family](method, *args)
    raise ValueError(f"unknown function @{name}")


def nothing(*_: Value) -> Value:
    return null()
