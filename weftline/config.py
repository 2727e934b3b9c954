"""Reading jobs: files, inheritance, environment, parameters, YAML's shorter forms."""

from __future__ import annotations

import copy
import importlib
import inspect
import json
import os
import re
import typing
from collections.abc import Callable
from pathlib import Path
from typing import Any

_NAMED = ("databases", "caches")
_ADDED = ("pipelines", "states", "dependencys")


def read(path: str) -> dict:
    """A JSON or YAML document; ``${NAME:default}`` comes from the environment."""
    if path.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(path) as r:  # noqa: S310
            text = r.read().decode()
    else:
        text = Path(path).read_text(encoding="utf-8")
    text = re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), text)
    if path.endswith((".yaml", ".yml")):
        import yaml

        return plain(yaml.safe_load(text))
    return json.loads(text)


def plain(x: Any) -> Any:
    """YAML's forms as the JSON ones: ``#word: [..]`` is a list, ``return:`` a return part, ``<<``/``>>`` value and default of a choice."""
    if isinstance(x, list):
        return [plain(v) for v in x]
    if not isinstance(x, dict):
        return x
    if set(x) == {"return"}:
        r = plain(x["return"])
        while isinstance(r, list) and len(r) == 1:
            r = r[0]
        return f":{r}" if isinstance(r, str) else [f":{r[0]}" if isinstance(r[0], str) else r[0], *r[1:]]
    for head, body in x.items():
        name = head.partition("|")[0]
        if name in ("#case", "#match") and isinstance(body, dict):
            out = {name: plain(body.get("<<"))}
            out |= {k: plain(v) for k, v in body.items() if k not in ("<<", ">>")}
            return out | ({"#end": plain(body[">>"])} if ">>" in body else {})
        if name in ("#case", "#match") and isinstance(body, list):
            out = {name: plain(body[0])}
            for b in body[1:]:
                out |= {k: plain(v) for k, v in b.items()} if isinstance(b, dict) else {"#end": plain(b)}
            return out
        if name.startswith(("#", "@")) and len(x) == 1 and isinstance(body, list):
            return [head, *plain(body)]
    return {k: plain(v) for k, v in x.items()}


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``: objects by key, databases and caches by name, pipelines and states one after the other."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        if key in _NAMED:
            by = {d["name"]: d for d in out.get(key, [])}
            for d in value:
                by[d["name"]] = by.get(d["name"], {}) | d
            out[key] = list(by.values())
        elif key in _ADDED:
            out[key] = [*out.get(key, []), *value]
        elif isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = out[key] | value
        else:
            out[key] = copy.deepcopy(value)
    return out


def resolve(config: dict, folder: str = ".") -> dict:
    """The config on top of all that it extends."""
    out: dict = {}
    extends = config.get("extends", [])
    for e in [extends] if isinstance(extends, (str, dict)) else extends:
        out = merged(out, load(e, folder) if isinstance(e, str) else resolve(e, folder))
    return merged(out, {k: v for k, v in config.items() if k != "extends"})


def load(path: str, folder: str = ".") -> dict:
    here = path if path.startswith("http") or os.path.exists(path) else os.path.join(folder, path)
    return resolve(read(here), folder)


def arguments(config: dict, given: dict) -> dict:
    """Parameters with their defaults; ``choices`` are kept to."""
    out = {}
    for a in config.get("arguments", []):
        name = a["name"]
        value = given.get(name, os.environ.get(name.upper(), a.get("default")))
        kind = {"int": int, "float": float, "str": str, "bool": bool}.get(a.get("type", ""), lambda v: v)
        value = None if value is None else kind(value)
        if a.get("choices") and value is not None and value not in a["choices"]:
            raise ValueError(f"{name} is one of {a['choices']}")
        out[name] = value
    return out | given


def substitute(x: Any, args: dict, sources: dict | None = None) -> Any:
    """``?name`` by a parameter's value and ``%name`` by the text of a source file."""
    sources = x.get("sources", {}) if sources is None and isinstance(x, dict) else sources or {}
    if isinstance(x, str):
        if x.startswith("?") and x[1:] in args:
            return args[x[1:]]
        if x.startswith("%") and x[1:] in sources:
            path = sources[x[1:]]
            return read(path) if path.endswith((".json", ".yaml", ".yml")) else Path(path).read_text(encoding="utf-8")
        return x
    if isinstance(x, list):
        return [substitute(v, args, sources) for v in x]
    if isinstance(x, dict):
        return {k: substitute(v, args, sources) for k, v in x.items()}
    return x


# The operators' names in parameters.
OPERATORS = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in"}


def querys(tests: dict, args: dict) -> dict:
    """The source filters, with parameters ``key`` and ``key__op`` put over their values."""
    out = {k: dict(t) if isinstance(t, dict) else {"==": t} for k, t in tests.items()}
    for key in out:
        name = key.partition("|")[0]
        if name in args:
            out[key] = {"==": args[name]}
        for op, sign in OPERATORS.items():
            if f"{name}__{op}" in args:
                value = args[f"{name}__{op}"]
                out[key][sign] = value.split(",") if sign == "in" and isinstance(value, str) else value
    return out


def imported(imports: dict) -> dict[str, Callable]:
    """``imports: {name: "package.module"}`` as ``name::function`` for each public function."""
    out = {}
    for name, path in imports.items():
        module = path
        if isinstance(path, str):
            try:
                module = importlib.import_module(path)
            except ModuleNotFoundError:
                top, _, attr = path.rpartition(".")
                module = getattr(importlib.import_module(top), attr)
        if callable(module):
            out[name] = module
        else:
            out |= {f"{name}::{n}": f for n, f in inspect.getmembers(module, inspect.isfunction) if not n.startswith("_")}
    return out


def typing_of(fn: Callable) -> tuple[str, bool]:
    """The SQL type a function returns, from its annotation, and whether it takes pandas Series."""
    import pandas as pd

    hints = typing.get_type_hints(fn) if inspect.isfunction(fn) else {}
    kind = getattr(fn, "return_type", None) or {int: "long", float: "double", str: "string", bool: "boolean", bytes: "binary"}.get(hints.get("return"), "string")
    return kind, any(h is pd.Series for n, h in hints.items() if n != "return")
