"""Expressions of a job to columns.

Lookups become joins and yields become explodes on the frame that the compiler
holds; everything else is columns.  Scopes are a list of values, the current one
last; ``$$`` looks one further back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import call
from weftline.functions.registry import FOLDS
from weftline.lang.casts import cast
from weftline.lang.values import LONG, NULL, Value, array, common, compare, is_number, is_time, literal, null, struct, truthy, widened
from weftline.plans import scan

SEQ = "_seq"
#: Most rows of a table that one task holds beside others.
LISTED = 100_000
_REF = re.compile(r"^(\$+)(?:\.([^|]*))?(?:\|(.*))?$", re.S)


class Accumulator(Exception):
    """An expression that was thought free of the accumulator reads it."""


@dataclass(frozen=True)
class Guard(Value):
    def field(self, name: str) -> Value:
        raise Accumulator(name)


@dataclass(frozen=True)
class Item(Value):
    """A value of a loop that may say to skip the element, or to stop: before it, or after it where ``last`` holds."""

    skip: Column | None = None
    stop: Column | None = None
    last: Column | None = None


@dataclass(frozen=True)
class Matched(Value):
    """The only match of a lookup, its columns beside the row's own: reading a field reads a column, and no more."""

    prefix: str = ""

    def _row(self) -> Column:
        kind = self.type.elementType
        return F.when(F.col(f"{self.prefix}hit"), F.struct(*[F.col(f"`{self.prefix}__{n}`").alias(n) for n in kind.names]))

    def field(self, name: str) -> Value:
        kind = self.type.elementType
        return Value(F.col(f"`{self.prefix}__{name}`"), kind[name].dataType).plain() if name in kind.names else null()

    def one(self) -> Value:
        return Value(self._row(), self.type.elementType)

    def plain(self) -> Value:
        return self


@dataclass
class Fold:
    """A field that is aggregated by a key: a recognised kind, or a step from state and row to state."""

    key: Value
    kind: str
    value: Value | None = None
    when: Column | None = None
    step: Callable[[Value, Value], Value] | None = None
    scopes: Value | None = None


@dataclass
class Windowed:
    key: Value
    order: list[tuple[Value, bool]]
    ordered: bool
    kind: str
    value: Value
    step: Callable[[Value], Value] | None
    ret: Callable[[Value], Value]


@dataclass
class Lambda:
    """An expression that a function applies to values of its own, which are ``$`` in it."""

    body: object
    scope: list[Value]
    compiler: Compiler
    type: T.DataType = NULL
    const: object = None

    def __call__(self, v: Value) -> Value:
        return self.compiler(self.body, [*self.scope, v]).one()


def is_return(x) -> bool:
    return isinstance(x, str) and x.startswith(":") and not x.startswith("::") or isinstance(x, list) and bool(x) and isinstance(x[0], str) and x[0].startswith(":")


def unreturned(x):
    return x[1:] if isinstance(x, str) else [x[0][1:], *x[1:]]


def row_value(df: DataFrame) -> Value:
    names = [n for n in df.columns if n != SEQ]
    kind = T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])
    return Value(F.struct(*[F.col(f"`{n}`") for n in names]), kind)


class Compiler:
    def __init__(self, df: DataFrame, table: Callable[[str], DataFrame], unique: set[str] = frozenset(), defines: dict | None = None, variables: dict | None = None, states: dict | None = None, field: str = "", filtered: Callable[[str, dict], tuple[DataFrame, dict]] | None = None, keyed: Callable[[str], Callable[[DataFrame], DataFrame] | None] | None = None):
        self.df, self.table, self.unique = df, table, set(unique)
        self.filtered, self.keyed = filtered, keyed
        self.defines, self.variables, self.states = defines or {}, dict(variables or {}), states or {}
        self.field = field
        self.columns = list(df.columns)
        self._joined: dict[str, Value] = {}
        self._yielded: dict[str, Value] = {}

    # --- scopes ---------------------------------------------------------------------------------

    def root(self) -> Value:
        kind = T.StructType([T.StructField(n, self.df.schema[n].dataType) for n in self.columns if n != SEQ])
        return Value(F.struct(*[F.col(f"`{n}`") for n in kind.names]), kind)

    def read(self, ref: str, scope: list[Value]) -> Value:
        m = _REF.match(ref)
        back, path, as_ = len(m[1]), m[2], m[3]
        if back > len(scope):
            raise ValueError(f"{ref!r} looks beyond the outermost scope")
        v = scope[-back]
        v = self.path(v, path) if path not in (None, "", "*") else v
        v = v if v.rows else v.plain()
        return cast(v, as_) if as_ else v

    def path(self, v: Value, path: str) -> Value:
        if isinstance(v.type, T.StructType) and path in v.type.names:  # a literal name that holds dots
            return v.field(path)
        for part in re.findall(r":-?\d*(?::-?\d*){0,2}|[^.]+", path):
            if part == "*":
                continue
            if part.startswith(":"):
                places = part[1:].split(":")
                if len(places) == 1:
                    v = self.element(v, int(places[0]))
                else:
                    start, stop = (int(p) if p else None for p in places[:2])
                    stop = stop if stop is not None else 2**31 - 1
                    v = call("substring", [Value(v.col, v.type), literal(start or 0), literal(stop), *([literal(int(places[2]))] if len(places) > 2 else [])])
            else:
                v = v.field(part)
        return v.plain()

    def element(self, v: Value, i: int) -> Value:
        if not isinstance(v.type, T.ArrayType):
            return v if i == 0 else null()
        return Value(F.get(v.col, F.lit(i)) if i >= 0 else F.try_element_at(v.col, F.lit(i)), v.type.elementType).plain()

    # --- expressions ------------------------------------------------------------------------------

    def __call__(self, x, scope: list[Value]):
        if isinstance(x, str):
            if x.startswith("$"):
                return self.read(x, scope)
            if x.startswith("@"):
                return self.function([x], scope)
            if x in ("#continue", "#break"):
                return Item(F.lit(None), NULL, skip=F.lit(True) if x == "#continue" else None, stop=F.lit(True) if x == "#break" else None)
            return literal(x)
        if isinstance(x, dict):
            for head in ("#case", "#match"):
                if head in x:
                    return self.choose(head, x, scope)
            return literal(x)
        if not isinstance(x, list) or not x:
            return literal(x)
        head = x[0]
        if isinstance(head, str):
            if head.startswith("@"):
                return self.function(x, scope)
            if head.startswith("&"):
                return self.load(x, scope)
            name, _, as_ = head.partition("|")
            if name.startswith("#"):
                if name in ("#continue", "#break"):  # with a value that is kept
                    kept = self(x[1], scope) if len(x) > 1 else null()
                    return Item(kept.one().col, kept.one().type, skip=F.lit(len(x) == 1) if name == "#continue" else None, stop=F.lit(True) if name == "#break" else None, last=F.lit(len(x) > 1) if name == "#break" else None)
                fn = getattr(self, "do_" + name[1:], None)
                if fn is None:
                    raise ValueError(f"unknown directive {name}")
                made = fn(x, scope)
                return cast(made, as_) if as_ and isinstance(made, Value) and name in ("#let", "#yield", "#assign", "#state", "#cache") else made
        if len(x) > 1 and isinstance(self.reference(x[1]), str):
            return self.lookup(x, scope)
        if isinstance(head, dict) and len(x) == 2 and is_return(x[1]):
            return self.returned(self(head, scope), x[1], scope)
        if isinstance(head, str) and head.startswith("$") and len(x) == 2 and is_return(x[1]):
            return self.returned(self(head, scope), x[1], scope)
        return literal(x)

    def reference(self, x):
        """The table reference of a lookup's second part, or None."""
        x = x[0] if isinstance(x, list) and x else x
        return x if isinstance(x, str) and x.startswith("&") else None

    def returned(self, v, ret, scope: list[Value]):
        if ret is None:
            return v
        if isinstance(v, Windowed):
            inner = v.ret
            v.ret = lambda made: self(unreturned(ret), [*scope, inner(made)])
            return v
        return self(unreturned(ret), [*scope, v])

    def function(self, x: list, scope: list[Value]):
        name, _, as_ = x[0][1:].partition("|")
        args = [a for a in x[1:] if not is_return(a)]
        ret = next((a for a in x[1:] if is_return(a)), None)
        v = call(name, [self(a, scope) for a in args])
        return self.returned(cast(v, as_) if as_ else v, ret, scope)

    @staticmethod
    def parts(x: list) -> tuple[list, object]:
        return (x[:-1], x[-1]) if len(x) > 1 and is_return(x[-1]) else (x, None)

    def do_const(self, x: list, scope):
        return literal(x[1] if len(x) == 2 else x[1:])

    def merge(self, branches: list[tuple[Column, object]], other) -> Value:
        """Branches by condition; loop marks travel along."""
        every = [v for _, v in branches] + [other]
        kind = common([v.one().type for v in every])
        out, marks = F.lit(None).cast(kind) if other.type == NULL else other.one().col.cast(kind), {}
        for mark in ("skip", "stop", "last"):
            marks[mark] = getattr(other, mark, None)
        for cond, v in reversed(branches):
            out = F.when(cond, F.lit(None).cast(kind) if v.type == NULL else v.one().col.cast(kind)).otherwise(out)
            for mark in ("skip", "stop", "last"):
                mine, rest = getattr(v, mark, None), marks[mark]
                if mine is not None or rest is not None:
                    marks[mark] = F.when(cond, F.lit(False) if mine is None else mine).otherwise(F.lit(False) if rest is None else rest)
        if marks["skip"] is None and marks["stop"] is None:
            return Value(out, kind)
        return Item(out, kind, **marks)

    def do_if(self, x: list, scope):
        items, ret = self.parts(x)
        cond = truthy(self(items[1], scope))
        other = self(items[3], scope) if len(items) > 3 else null()
        return self.returned(self.merge([(cond, self(items[2], scope))], other), ret, scope)

    def conditions(self, head: str, x: dict, scope) -> list[tuple[Column, object, list[Value]]]:
        """(condition, branch, scope of the branch) in order, without the default."""
        v = self(x[head], scope).one()
        out = []
        for key, branch in x.items():
            if key in (head, "#end"):
                continue
            if head == "#case":
                k = int(key[1:]) if re.fullmatch(r":-?\d+", key) else key
                if isinstance(k, int) != (v.type == LONG) and isinstance(k, str) and v.type == LONG:
                    continue  # a text never equals a number
                out.append((F.coalesce(v.col == F.lit(k), F.lit(False)), branch, scope))
            else:
                out.append(self.matcher(key, branch, v, scope))
        return out

    def matcher(self, key: str, branch, v: Value, scope):
        text = cast(v, "str").col
        if (m := re.fullmatch(r"/(.*)/([ailumsx]*)", key, re.S)) is not None:
            flags = "".join(f for f in m[2] if f in "imsx")
            pattern = f"(?{flags})^(?:{m[1]})" if flags else f"^(?:{m[1]})"
            groups = len(re.findall(r"(?<!\\)\((?!\?)", m[1]))
            found = array([Value(F.regexp_extract(text, pattern, i), T.StringType()) for i in range(1, groups + 1)]) if groups else literal([])
            state = struct({"match": Value(F.regexp_extract(text, pattern, 0), T.StringType()), "match_groups": found, "value": v})
            return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), branch, [*scope, state]
        if key[:1] + key[-1:] in ("[]", "()", "{}"):
            return self.member(key, branch, v, scope)
        tests = re.findall(r"(>=|<=|!=|==|=|>|<)\s*([^,]+)", key)
        if tests:
            cond = F.lit(True)
            for op, limit in tests:
                number = re.fullmatch(r"-?\d+(\.\d+)?", limit.strip())
                bound = literal(float(limit) if "." in limit else int(limit)) if number else literal(limit.strip())
                cond = cond & compare({"=": "=="}.get(op, op), v, bound)
            return cond & v.col.isNotNull(), branch, [*scope, struct({"match_key": v, "match": v, "value": v})]
        return F.coalesce(text == key, F.lit(False)), branch, [*scope, struct({"match_key": v, "match": v, "value": v})]

    def member(self, key: str, branch, v: Value, scope):
        """A JSON list ``[..]``, a list ``(..)`` whose texts may be matchers themselves, or the keys of a JSON map ``{..}``; what is no JSON holds nothing."""
        try:
            items = json.loads(f"[{key[1:-1]}]" if key[0] == "(" else key)
        except ValueError:
            items = []
        found, text = [], cast(v, "str").col
        for at, item in items.items() if isinstance(items, dict) else enumerate(items):
            if key[0] == "(" and isinstance(item, str) and (item[:1] + item[-1:] in ("[]", "()", "{}") or re.fullmatch(r"/.*/[ailumsx]*", item, re.S) or item[:1] in "<>"):
                found.append((self.matcher(item, branch, v, scope)[0], literal(None), literal(None)))
                continue
            value = literal(item) if not isinstance(items, dict) else literal(at)
            same = F.lit(False) if value.type == NULL or is_number(value.type) != is_number(v.type) else text == cast(value, "str").col
            same = v.col.cast("double") == value.col.cast("double") if is_number(value.type) and is_number(v.type) else same
            found.append((F.coalesce(same, F.lit(False)), literal(at), literal(item)))
        hit = F.lit(False)
        for c, _, _ in found:
            hit = hit | c
        state = {"match": literal(key), "value": v}
        if found:
            state |= {"match_key": self.merge([(c, k) for c, k, _ in found], null()), "match_value": self.merge([(c, m) for c, _, m in found], null())}
        return hit, branch, [*scope, struct(state)]

    def choose(self, head: str, x: dict, scope):
        branches = [(c, self(b, s)) for c, b, s in self.conditions(head, x, scope)]
        return self.merge(branches, self(x["#end"], scope) if "#end" in x else null())

    def do_case(self, x: list, scope):
        items, ret = self.parts(x)
        return self.returned(self.choose("#case", {"#case": items[1], **items[2]}, scope), ret, scope)

    def do_match(self, x: list, scope):
        items, ret = self.parts(x)
        return self.returned(self.choose("#match", {"#match": items[1], **items[2]}, scope), ret, scope)

    def do_make(self, x: list, scope):
        items, ret = self.parts(x)
        body = items[1]
        if isinstance(body, dict):
            if all(not k.startswith(("$", "@")) for k in body):
                v = struct({k: self(e, scope).one() for k, e in body.items()})
            else:
                keys, values = [self(k, scope) for k in body], [self(e, scope) for e in body.values()]
                kind = common([e.type for e in values])
                v = Value(F.create_map(*[c for k, e in zip(keys, values, strict=True) for c in (cast(k, "str").col, e.col.cast(kind))]), T.MapType(T.StringType(), kind))
        elif isinstance(body, list) and not (body and isinstance(body[0], str) and body[0][:1] in "#@&"):
            v = self(body[0], scope) if len(body) == 1 else array([self(e, scope) for e in body])
        else:
            v = self(body, scope)
        return self.returned(v, ret, scope)

    def do_let(self, x: list, scope):
        items, ret = self.parts(x)
        key, here = self(items[1], scope), scope[-1].one()
        if isinstance(here.type, T.MapType):
            v = Value(F.try_element_at(here.col, key.col.cast(here.type.keyType)), here.type.valueType)
        else:
            fields = {n: here.field(n) for n in here.type.names}
            kind = common([f.type for f in fields.values()])
            v = Value(F.coalesce(*[F.when(key.col == n, f.col.cast(kind)) for n, f in fields.items()]), kind)
        return self.returned(v, ret, scope)

    def do_call(self, x: list, scope):
        items, ret = self.parts(x)
        return self.returned(self(self.defines[items[1]], [*scope[:-1], self(items[2], scope)]), ret, scope)

    def do_lambda(self, x: list, scope):
        return Lambda(x[1], scope, self)

    def do_state(self, x: list, scope):
        items, ret = self.parts(x)
        state = struct({k: literal(v) for k, v in self.states.items()}) if self.states else literal({"_": None})
        v = self(items[1], [*scope, state])
        if len(items) > 2:
            default = self(items[2], scope)
            kind = common([v.type, default.type])
            v = Value(F.when(truthy(v), v.col.cast(kind)).otherwise(default.col.cast(kind)), kind)
        return self.returned(v, ret, scope)

    def do_cache(self, x: list, scope):
        items, ret = self.parts(x)
        return self.returned(self(items[3], scope), ret, scope)

    def do_assign(self, x: list, scope):
        """A variable: read, or changed row by row in order of arrival.

        Sums, products, extremes, new values and conditions between them are made in
        blocks of rows at a time; any other step goes through the rows in order.
        """
        items, ret = self.parts(x)
        name = items[1]
        start = literal(self.variables.get(name))
        if len(items) == 2:
            return self.returned(start, ret, scope)
        calc, mine = items[2], f"$.{name}"
        free = lambda e: self(e, [*scope, Guard(F.lit(None), NULL)])
        if isinstance(calc, list) and len(calc) == 3 and calc[0] == "@add" and calc[1] == mine and (by := self.free(calc[2], free)) is not None:
            total = self.running(by)
            v = Value(F.coalesce(start.col, F.lit(0)).cast(by.type) + F.coalesce(total, F.lit(0)).cast(by.type) if start.type != NULL else total, by.type)
            return self.returned(v, ret, scope)
        found = extreme(calc, mine, lambda e: self.free(e, free), start) or affine(calc, mine, lambda e: self.free(e, free), start)
        v = self.composed(found, start) if found is not None else self.stepped(name, start, calc, scope)
        return self.returned(v, ret, scope)

    @staticmethod
    def free(e, value: Callable[[object], Value]) -> Value | None:
        """The value of an expression that does not read the variable; None if it does."""
        try:
            return value(e).one()
        except Accumulator:
            return None

    def composed(self, found: Composed, start: Value) -> Value:
        """A variable whose steps compose: blocks of rows are summed up as one step each."""
        (self.df, place), into = scan.numbered(self.df, F.col(SEQ)), f"__var{len(self._joined)}"
        self.df = scan.prefixes(self.df, F.col(SEQ), place, found.one, found.kind, found.identity, found.compose, into)
        self._joined[into] = v = Value(found.apply(F.col(into)), found.type)
        return v

    def stepped(self, name: str, start: Value, calc, scope: list[Value]) -> Value:
        """Any other variable: all rows in order of arrival are one group of an ordered fold."""
        kinds, into = [v.type for v in scope], f"__var{len(self._joined)}"
        blank = [Value(F.lit(None).cast(k), k) for k in kinds]
        out = start.type
        for _ in range(2):
            out = self(calc, [*blank, struct({name: Value(F.lit(None).cast(out), out)})]).one().type
        out = common([start.type, out])
        kind = T.StructType([T.StructField("v", out)])

        def step(acc: Column, x: Column) -> Column:
            back = [Value(x["s"][f"s{i}"], k) for i, k in enumerate(kinds)]
            state = Value(F.when(acc.isNull(), start.col.cast(out)).otherwise(acc["v"]), out)
            return F.struct(self(calc, [*back, struct({name: state})]).one().col.cast(out).alias("v"))

        row = F.struct(F.struct(*[F.col(f"`{n}`") for n in self.df.columns]).alias("r"), struct({f"s{i}": v for i, v in enumerate(scope)}).col.alias("s"))
        keyed = self.df.select(F.lit(0).alias(scan.KEY), F.col(SEQ), row.alias(scan.ROW))
        made = scan.Scan(scan.each(step, kind), kind, each=True).over(keyed, [F.col(SEQ)])
        self.df = made.select(f"{scan.ROW}.r.*", F.col(f"{scan.STATE}.v").alias(into))
        self._joined[into] = v = Value(F.col(into), out)
        return v

    def running(self, by: Value) -> Column:
        """The sum of a value over all rows up to each one, in order of arrival.

        Rows are summed up in blocks of 65,536 places, and a block begins with the
        sum of those before it; only one row a block is ever in one task.  An order
        that is no integer has no blocks and is one window.
        """
        kind = self.df.schema[SEQ].dataType
        place = F.col(SEQ) if kind == LONG else F.col(f"{SEQ}.row") if isinstance(kind, T.StructType) and kind[0].dataType == LONG else None
        if place is None:
            return F.sum(by.col).over(Window.orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0))
        name = f"__run{len(self._joined)}"
        block, value, before = f"{name}b", f"{name}v", f"{name}s"
        df = self.df.withColumns({block: F.shiftright(F.coalesce(place, F.lit(-1)), 16), value: by.col})
        earlier = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        totals = df.groupBy(block).agg(F.sum(value).alias(before)).select(block, F.sum(before).over(earlier).alias(before))
        self.df = df.join(totals, block)
        inner = F.sum(value).over(Window.partitionBy(block).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0))
        self._joined[name] = Value(F.col(before), by.type)
        return F.when(inner.isNull() & F.col(before).isNull(), None).otherwise(F.coalesce(inner, F.lit(0).cast(by.type)) + F.coalesce(F.col(before), F.lit(0).cast(by.type))).cast(by.type)

    # --- lists ------------------------------------------------------------------------------------

    def do_foreach(self, x: list, scope):
        items, ret = self.parts(x)
        v = self(items[1], scope)
        if isinstance(v.type, T.MapType):
            v = Value(F.map_entries(v.col), T.ArrayType(T.StructType([T.StructField("key", v.type.keyType), T.StructField("value", v.type.valueType)])))
        v = cast(v, "array") if not isinstance(v.type, T.ArrayType) else Value(v.col, v.type)
        kind = v.type.elementType

        def entry(e: Column, i: Column) -> Value:
            inner = Value(e, kind)
            if isinstance(kind, T.StructType):
                return struct({n: inner.field(n) for n in kind.names} | {"_index_": Value(i.cast("long"), LONG)})
            return struct({"_index_": Value(i.cast("long"), LONG), "_value_": inner.plain()})

        probe = self(items[2], [*scope, entry(F.lit(None).cast(kind), F.lit(0))])
        out = T.StringType() if probe.type == NULL else probe.type

        def one(e: Column, i: Column) -> Column:
            made = self(items[2], [*scope, entry(e, i)])
            marks = {mark: getattr(made, mark, None) for mark in ("skip", "stop", "last")}
            return F.struct(made.one().col.cast(out).alias("v"), *[(F.lit(False) if c is None else c).alias(mark) for mark, c in marks.items()])

        each = F.transform(v.col, one)
        if getattr(probe, "stop", None) is not None:
            at = F.array_position(F.transform(each, lambda s: s["stop"]), True)
            kept = at - F.when(F.get(each, (at - 1).cast("int"))["last"], 0).otherwise(1)
            each = F.when(at > 0, F.slice(each, F.lit(1), kept.cast("int"))).otherwise(each)
        if getattr(probe, "skip", None) is not None:
            each = F.filter(each, lambda s: ~s["skip"])
        return self.returned(Value(F.transform(each, lambda s: s["v"]), T.ArrayType(out)), ret, scope)

    # --- yields -------------------------------------------------------------------------------------

    def expand(self, lists: list) -> None:
        """Explode several lists of the source row together, in lock-step."""
        lists = [x for x in {json.dumps(x): x for x in lists}.values() if json.dumps(x) not in self._yielded]
        if not lists:
            return
        cols, kinds = [], []
        for x in lists:
            v = self(x, [self.root()])
            wrapped = Value(v.col, v.type) if isinstance(v.type, T.ArrayType) else array([v])
            cols.append(F.coalesce(wrapped.col, F.array(F.lit(None).cast(wrapped.type.elementType))))
            kinds.append(wrapped.type.elementType)
        df = self.df.withColumns({f"__list{i}": c for i, c in enumerate(cols)})
        sizes = [F.size(f"__list{i}") for i in range(len(cols))]
        for s in sizes:
            df = df.where(s > 0)  # an empty list drops its row
        n = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        df = df.withColumn("__at", F.explode(F.sequence(F.lit(0), n - 1)))
        base = len(self._yielded)
        for i, x in enumerate(lists):
            name = f"__y{base + i}"
            element = F.when(sizes[i] == 1, F.get(f"__list{i}", 0)).otherwise(F.get(f"__list{i}", F.col("__at")))
            df = df.withColumn(name, element)
            self._yielded[json.dumps(x)] = Value(F.col(name), kinds[i]).plain()
        if SEQ in df.columns:
            df = df.withColumn(SEQ, F.struct(F.col(SEQ), F.col("__at")) if not isinstance(df.schema[SEQ].dataType, T.LongType) else F.struct(F.col(SEQ).alias("row"), F.col("__at").alias("at")))
        self.df = df.drop("__at", *[f"__list{i}" for i in range(len(cols))])

    def do_yield(self, x: list, scope):
        items, ret = self.parts(x)
        key = json.dumps(items[1])
        if len(scope) == 1:
            self.expand([items[1]])
            v = self._yielded[key]
        else:  # a yield inside a yield expands again
            made = self(items[1], scope)
            name = f"__n{len(self._joined) + len(self._yielded)}_{len(scope)}"
            made = made if isinstance(made.type, T.ArrayType) else array([made])
            self.df = self.df.withColumn(name, F.explode(F.coalesce(F.when(F.size(made.col) > 0, made.col), F.when(made.col.isNull(), F.array(F.lit(None).cast(made.type.elementType))))))
            self._yielded[f"{key}{len(scope)}"] = v = Value(F.col(name), made.type.elementType).plain()
        return self.returned(v, ret, scope)

    # --- lookups -------------------------------------------------------------------------------------

    def parse_reference(self, ref: str) -> tuple[bool, str, list[str]]:
        many, rest = ref.startswith("&&"), ref.lstrip("&").lstrip(".")
        name, _, keys = rest.partition("::")
        return many, name, [k.partition("|")[0] for k in keys.split("+")] if keys else []

    def right(self, part, scope) -> DataFrame:
        """The table of a reference, its constant filters applied."""
        ref, filters = (part[0], part[1] if len(part) > 1 else {}) if isinstance(part, list) else (part, {})
        name, filters = self.parse_reference(ref)[1], filters or {}
        if self.filtered is not None and filters and all(not isinstance(v, list) or not v or v[0][:1] not in ("@", "#") for t in filters.values() for v in (t.values() if isinstance(t, dict) else [t])):
            df, filters = self.filtered(name, {k: t if isinstance(t, dict) else {"==": t} for k, t in filters.items()})
        else:
            df = self.table(name)
        return self.kept(df, filters)

    def kept(self, df: DataFrame, filters: dict) -> DataFrame:
        for key, tests in filters.items():
            df = df.where(source_filter(df, key, tests, lambda e: self(e, [])))
        return df

    def answered(self, ask: Callable[[DataFrame], DataFrame], part, names: list[str], values: list[Value]) -> DataFrame:
        """The table of a function of keys: it is asked for each different key once."""
        cols = [F.explode(v.col).alias(n) if isinstance(v.type, T.ArrayType) and not v.rows else v.one().col.alias(n) for v, n in zip(values, names, strict=True)]
        keys = self.df.select(*cols)
        for n in names:
            keys = keys.where(F.col(f"`{n}`").isNotNull())
        return self.kept(ask(keys.distinct()), part[1] if isinstance(part, list) and len(part) > 1 else {})

    def aggregated(self, ret, right: DataFrame) -> tuple[Column, T.DataType, object] | None:
        """A return part that is an aggregate of the matches' field: its column, type and value for no match."""
        ret = unreturned(ret) if ret is not None and is_return(ret) else None
        if not (isinstance(ret, list) and len(ret) in (2, 3) and ret[0] in ("@sum", "@max", "@min") and all(isinstance(a, str) for a in ret)):
            return None
        if len(ret) == 3 and ret[0] == "@sum" and re.fullmatch(r"\$(\.\*)?(\|array)?", ret[1]):
            name = ret[2]
        elif len(ret) == 2 and (m := re.fullmatch(r"\$\.([A-Za-z_]\w*)", ret[1])) is not None:
            name = m[1]
        else:
            return None
        if name not in right.columns:
            return None
        kind = widened(right.schema[name].dataType)
        fn = {"@sum": F.sum, "@max": F.max, "@min": F.min}[ret[0]]
        return fn(F.col(name).cast(kind)), kind, 0 if ret[0] == "@sum" else None

    def lookup(self, x: list, scope):
        key, part, rest = x[0], x[1], x[2:]
        ret = next((r for r in rest if is_return(r)), None)
        residual = next((r for r in rest if not is_return(r)), None)
        many, name, names = self.parse_reference(self.reference(part))
        keys = key if isinstance(key, list) and len(names) > 1 else [key]
        # a cast on the table's side, too, is one of the value that is looked up
        casts = [k.partition("|")[2] for k in self.reference(part).partition("::")[2].split("+")]
        values = [self(k, scope) for k in keys]
        values = [cast(v, c) if c else v for v, c in zip(values, casts, strict=True)] if len(casts) == len(values) else values
        ask = self.keyed(name[2:]) if self.keyed is not None and name.startswith("=@") else None
        right = self.right(part, scope) if ask is None else self.answered(ask, part, names, values)
        tag = json.dumps([part, [str(v.col._jc.toString()) for v in values], many])
        own = [F.col(f"`{n}`").cast(widened(right.schema[n].dataType)) for n in names]
        row = F.struct(*[F.col(f"`{n}`").cast(widened(right.schema[n].dataType)).alias(n) for n in right.columns])
        kind = T.StructType([T.StructField(n, widened(right.schema[n].dataType)) for n in right.columns])
        col = f"__k{len(self._joined)}"
        on = [f"{col}_{i}" for i in range(len(names))]
        keyed = right.select(*[c.alias(o) for c, o in zip(own, on, strict=True)], row.alias(col))
        if len(values) == 1 and isinstance(values[0].type, T.ArrayType) and not values[0].rows:
            return self.returned(self.residual(self.lookup_each(values[0], keyed, on, col, kind), residual, scope), ret, scope)
        values = [v.one() for v in values]
        cond = [v.col.cast(keyed.schema[o].dataType) == F.col(o) for v, o in zip(values, on, strict=True)]
        cond = [c for c in cond]
        whole = cond[0]
        for c in cond[1:]:
            whole = whole & c

        def join(table: DataFrame) -> None:
            self.df = self.df.join(table, whole, "left").drop(*on)

        if residual is not None and not many and len(scope) == 1 and (read := self.read_of(residual)) is not None:
            agg = self.aggregated(ret, right)
            tag += json.dumps([residual, ret if agg is not None else None])
            if tag not in self._joined:
                self._joined[tag] = self.conditional(values, read, keyed, on, col, kind, residual, right, agg)
            return self._joined[tag] if agg is not None else self.returned(self._joined[tag], ret, scope)
        summed = None if residual or many else self.aggregated(ret, right)
        if summed is not None:
            agg, out, absent = summed
            tag += json.dumps(ret)
            if tag not in self._joined:
                join(right.groupBy(*[c.alias(o) for c, o in zip(own, on, strict=True)]).agg(agg.alias(col)))
                self._joined[tag] = Value(F.coalesce(F.col(col), F.lit(absent).cast(out)) if absent is not None else F.col(col), out)
            return self._joined[tag]
        if tag not in self._joined:
            if many:
                if residual is not None:
                    both = self.df.join(keyed, whole, "left")
                    keep = F.when(F.col(col).isNull(), False).otherwise(truthy(self(residual, [*scope, Value(F.col(col), kind)])))
                    seen = keyed
                    whole = whole & keep
                    del both
                    self.df = self.df.join(seen, whole, "left").drop(*on)
                else:
                    join(keyed)
                self._joined[tag] = Value(F.col(col), kind)
            elif name in self.unique:
                flat = [F.col(f"`{n}`").cast(kind[n].dataType).alias(f"{col}__{n}") for n in kind.names]
                join(right.select(*[c.alias(o) for c, o in zip(own, on, strict=True)], *flat, F.lit(True).alias(f"{col}hit")))
                made = Matched(F.lit(None), T.ArrayType(kind), rows=True, single=True, prefix=col)
                self._joined[tag] = replace(made, col=F.when(F.col(f"{col}hit"), F.array(made._row())))
            else:
                order = F.array_sort(F.collect_list(F.struct(F.col("__o"), F.col(col))))
                grouped = keyed.withColumn("__o", F.monotonically_increasing_id()).groupBy(*on).agg(F.transform(order, lambda s: s[col]).alias(col))
                join(grouped)
                self._joined[tag] = Value(F.col(col), T.ArrayType(kind), rows=True)
        found = self._joined[tag]
        if residual is not None and not many:
            found = self.residual(found, residual, scope)
        return self.returned(found, ret, scope)

    def read_of(self, residual) -> list[str] | None:
        """The columns of the row that a lookup's condition reads; None where it reads more than columns."""
        text = json.dumps(residual)
        names = re.findall(r'"\$\$\.([A-Za-z_]\w*)(?=[|"])', text)
        whole = text.count("$$") == len(names) and "$$$" not in text and set(names) <= set(self.columns) and SEQ not in names
        return sorted(set(names)) if whole else None

    def bounds(self, residual, probe: Value, row: Value) -> tuple[str, Value, Value] | None:
        """(field of the table, from, to) where a condition holds a time between two of the row's: at or after one, at or before the other."""
        found: dict[str, dict[str, Value]] = {}
        parts = residual[1:] if isinstance(residual, list) and residual[:1] == ["@and"] else [residual]
        for part in parts:
            if not (isinstance(part, list) and len(part) == 3 and part[0] in ("@gt", "@gte", "@lt", "@lte") and all(isinstance(e, (str, list)) for e in part[1:])):
                continue
            for mine, other, op in ((part[1], part[2], part[0]), (part[2], part[1], {"g": "@l", "l": "@g"}[part[0][1]])):
                if isinstance(mine, str) and (m := re.fullmatch(r"\$\.([A-Za-z_]\w*)", mine)) is not None and not re.search(r'"\$[.*|"]', json.dumps(other)):
                    v = self(other, [probe, row]).one()
                    if is_time(v.type) and m[1] in row.type.names and is_time(row.type[m[1]].dataType):
                        found.setdefault(m[1], {}).setdefault(op[1], v)
        return next(((name, ends["g"], ends["l"]) for name, ends in found.items() if len(ends) == 2), None)

    def conditional(self, values: list[Value], read: list[str], keyed: DataFrame, on: list[str], col: str, kind, residual, right: DataFrame, agg) -> Value:
        """Matches that a condition holds of, found while joining: only they are collected, or summed up.

        Each different combination of keys and columns that the condition reads is joined
        once.  Where it holds a time between two others, both sides also meet by bins of the
        usual length of that range, so that a key with many matches is neither met whole nor by one task.
        """
        values, probe_kind = [v.one() for v in values], T.StructType([self.df.schema[n] for n in read])
        names = [f"{col}k{i}" for i in range(len(values))] + [f"{col}r{i}" for i in range(len(read))]
        cols = [v.col.cast(keyed.schema[o].dataType) for v, o in zip(values, on, strict=True)] + [F.col(f"`{n}`") for n in read]
        probes = self.df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)]).distinct()
        probe = struct({n: Value(F.col(names[len(values) + i]), probe_kind[n].dataType).plain() for i, n in enumerate(read)}) if read else literal({"_": None})
        row = Value(F.col(col), kind)
        same = [F.col(n) == F.col(o) for n, o in zip(names, on, strict=False)]
        keep = truthy(self(residual, [probe, row]))
        table = keyed.withColumn("__o", F.monotonically_increasing_id())
        within = self.bounds(residual, probe, row)
        if within is None:
            met = probes.join(table, reduce(and_, [*same, keep]))
        else:
            field, low, high = within
            seconds = lambda c: c.cast("timestamp").cast("double")
            ends = probes.withColumns({f"{col}lo": seconds(low.col), f"{col}hi": seconds(high.col)})
            lo, hi = F.col(f"{col}lo"), F.col(f"{col}hi")
            usual = ends.select(F.avg(F.when(hi >= lo, hi - lo)).alias("w")).first()["w"]
            width = max(float(usual or 0), 1.0)
            known = ends.where(hi >= lo).withColumn(f"{col}b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
            binned = table.withColumn(f"{col}c", F.floor(seconds(F.col(col)[field]) / width))
            met = known.join(binned, reduce(and_, [*same, F.col(f"{col}b") == F.col(f"{col}c"), keep])).drop(f"{col}b", f"{col}c")
            open_ = ends.where(lo.isNull() | hi.isNull())  # null bounds nothing
            met = met.unionByName(open_.join(table, reduce(and_, [*same, keep]))).drop(f"{col}lo", f"{col}hi")
        if agg is not None:
            fn, out, absent = agg
            met = met.select(*names, f"{col}.*")
            found = met.groupBy(*names).agg(fn.alias(col))
        else:
            order = F.array_sort(F.collect_list(F.struct("__o", col)))
            found = met.groupBy(*names).agg(F.transform(order, lambda s: s[col]).alias(col))
        back = [c.eqNullSafe(F.col(n)) for c, n in zip(cols, names, strict=True)]
        self.df = self.df.join(found, reduce(and_, back), "left").drop(*names)
        if agg is not None:
            return Value(F.coalesce(F.col(col), F.lit(absent).cast(out)) if absent is not None else F.col(col), out)
        return Value(F.col(col), T.ArrayType(kind), rows=True)

    def residual(self, found: Value, residual, scope) -> Value:
        if residual is None:
            return found
        kind = found.type.elementType
        kept = F.filter(found.col, lambda r: truthy(self(residual, [*scope, Value(r, kind)])))
        return Value(kept, found.type, found.rows, found.single)

    def lookup_each(self, key: Value, keyed: DataFrame, on: list[str], col: str, kind) -> Value:
        """A list of keys: the matches of each, one after the other."""
        rid = f"{col}_list"  # each different list is looked up once
        self.df = self.df.withColumn(rid, key.col)
        exploded = self.df.select(rid).where(F.size(rid) > 0).distinct().select(rid, F.posexplode(rid).alias("__p", "__e"))
        order = F.array_sort(F.collect_list(F.struct(F.col("__p"), F.col("__o"), F.col(col))))
        found = exploded.join(keyed.withColumn("__o", F.monotonically_increasing_id()), F.col("__e") == F.col(on[0])).groupBy(rid).agg(F.transform(order, lambda s: s[col]).alias(col))
        self.df = self.df.join(found, rid, "left").drop(rid)
        self._joined[f"each{col}"] = v = Value(F.col(col), T.ArrayType(kind), rows=True)
        return v

    def load(self, x: list, scope):
        """A whole table, not keyed: one aggregate or one list for all rows, or with ``&&`` each row with each of the table's.

        A list holds at most :data:`LISTED` rows.  Rows meet a table of up to as many
        by broadcasting it; a larger one is cut into blocks of that size, and rows go to every block.
        """
        part = [x[0], x[1]] if len(x) > 1 and isinstance(x[1], dict) else x[0]
        ret = next((r for r in x[1:] if is_return(r)), None)
        right = self.right(part, scope)
        col = f"__l{len(self._joined)}"
        tag = json.dumps(["load", x])
        kind = T.StructType([T.StructField(n, widened(right.schema[n].dataType)) for n in right.columns])
        many = self.parse_reference(x[0])[0]
        summed = None if many else self.aggregated(ret, right)
        row = F.struct(*[F.col(f"`{n}`").cast(kind[n].dataType).alias(n) for n in kind.names])
        if tag in self._joined:
            pass
        elif summed is not None:
            self._joined[tag] = Value(F.col(col), summed[1])
            self.df = self.df.join(F.broadcast(right.agg(summed[0].alias(col))))  # one row
        elif not many:
            if right.limit(LISTED + 1).count() > LISTED:
                raise ValueError(f"{x[0]} has more than {LISTED} rows: too many for one list; && gives them as rows")
            self._joined[tag] = Value(F.col(col), T.ArrayType(kind), rows=True)
            self.df = self.df.join(F.broadcast(right.agg(F.collect_list(row).alias(col))))
        else:
            self._joined[tag] = Value(F.col(col), kind)
            table = right.select(row.alias(col))
            if table.limit(LISTED + 1).count() <= LISTED:
                self.df = self.df.join(F.broadcast(table), F.lit(True), "left")
            else:
                n, block = -(-table.count() // LISTED), f"{col}b"
                spread = self.df.withColumn(block, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
                self.df = spread.join(table.withColumn(block, F.pmod(F.xxhash64(col), F.lit(n)).cast("int")), block).drop(block)
        v = self._joined[tag]
        return v if summed is not None else self.returned(v, ret, scope)

    # --- folds -----------------------------------------------------------------------------------------

    def do_aggregate(self, x: list, scope):
        key, calc = self(x[1], scope), x[2]
        if isinstance(key, Fold):
            raise ValueError("an aggregate's key holds an aggregate")
        key = key.one()
        mine = f"$.{self.field}"
        free = lambda e: self(e, [*scope, Guard(F.lit(None), NULL)])
        try:
            return self.recognised(key, calc, mine, free, scope)
        except Accumulator:
            pass
        scopes = struct({f"s{i}": v for i, v in enumerate(scope)})
        kinds, field = [v.type for v in scope], self.field

        def step(state: Value, row: Value) -> Value:
            back = [Value(row.col[f"s{i}"], k) for i, k in enumerate(kinds)]
            return self(calc, [*back, struct({field: state})])

        return Fold(key, "steps", scopes=scopes, step=step)

    def recognised(self, key: Value, calc, mine: str, free, scope) -> Fold:
        if isinstance(calc, list) and len(calc) == 3 and calc[1] == mine:
            if calc[0] in ("@add", "@sum"):
                v = free(calc[2])
                return Fold(key, "sum", v) if v.type != T.StringType() else (_ for _ in ()).throw(Accumulator())
            if calc[0] in ("@max", "@min"):
                return Fold(key, calc[0][1:], free(calc[2]))
            if isinstance(calc[0], str) and calc[0][1:] in FOLDS:
                return Fold(key, f"udaf:{calc[0][1:]}", free(calc[2]))
            if calc[0] == "@array::append":
                return Fold(key, "list", free(calc[2]))
        if isinstance(calc, list) and calc and calc[0] == "#if" and len(calc) == 4 and mine in (calc[2], calc[3]):
            cond = truthy(free(calc[1]))
            hit, branch = (cond, calc[2]) if calc[3] == mine else (~cond, calc[3])
            if isinstance(branch, list) and len(branch) == 3 and branch[0] == "@add" and branch[1] == mine:
                return Fold(key, "sum", free(branch[2]), when=hit)
            return Fold(key, "last", free(branch), when=hit)
        if isinstance(calc, dict) and (head := "#case" if "#case" in calc else "#match" if "#match" in calc else None):
            guarded = [*scope, Guard(F.lit(None), NULL)]
            keeps = {mine} if head == "#case" else {mine, "$" + mine}
            found = self.conditions(head, calc, guarded)
            end = calc.get("#end")
            stay, branches = F.lit(False), []
            settled = F.lit(False)
            for cond, branch, inner in found:
                if branch in keeps if isinstance(branch, str) else False:
                    stay = stay | (cond & ~settled)
                else:
                    branches.append((cond & ~settled, self(branch, inner)))
                settled = settled | cond
            if end == mine:
                other, stay = null(), stay | ~settled
            else:
                other = self(end, guarded) if end is not None else null()
            return Fold(key, "last", self.merge(branches, other), when=~stay)
        return Fold(key, "last", free(calc))

    def do_partition(self, x: list, scope):
        items, ret = self.parts(x)
        key = self(items[1], scope).one()
        order_x, value_x, calc = items[2], items[3], items[4]
        ordered, order = order_x is not None and order_x != "", []
        if isinstance(order_x, dict):
            v = self(order_x["valuer"], scope)
            order = [(v, bool(order_x.get("orders") and order_x["orders"][0][1]))]
        value = self(value_x, scope).one()
        kinds = {"@add": "sum", "@max": "max", "@min": "min"}
        if isinstance(calc, list) and len(calc) == 3 and calc[0] in kinds and calc[1] == "$.state" and calc[2] == "$.value":
            kind, step = kinds[calc[0]], None
        elif isinstance(calc, list) and len(calc) == 3 and calc[0] == "@add" and calc[1] == "$.state" and calc[2] == 1:
            kind, step = "count", None
        elif isinstance(calc, list) and len(calc) == 3 and calc[0] == "@add" and calc[1] == "$.context.current_index" and calc[2] == 1:
            kind, step = "row_number", None
        elif calc == "$.value":
            kind, step = "last", None
        elif isinstance(calc, list) and calc and calc[0] in ("@rank", "@dense_rank", "@lag", "@lead", "@first", "@ntile", "@percent_rank", "@cume_dist"):
            kind, step = calc[0][1:] + (f":{calc[1]}" if len(calc) > 1 else ""), None
        else:
            kind, step = "steps", lambda context: self(calc, [*scope, context])
        return Windowed(key, order, ordered, kind, value, step, lambda v: self.returned(v, ret, scope) if ret is not None else v)


@dataclass
class Composed:
    """Steps of a variable that compose: what one row does, how two of them go together, and the value after it."""

    one: Column
    kind: T.DataType
    identity: Column
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column], Column]
    type: T.DataType


@dataclass
class Step:
    """v becomes ``a * v + b``; ``known`` says whether it is a value then, null as before."""

    a: Column
    b: Column
    known: Column
    types: list[T.DataType]
    factors: bool = False
    resets: bool = False


def extreme(calc, mine: str, free: Callable[[object], Value | None], start: Value) -> Composed | None:
    """``["@max", v, x]`` and ``["@min", v, x]``, also under conditions that otherwise keep the value."""
    cond = F.lit(True)
    while isinstance(calc, list) and len(calc) == 4 and calc[0] == "#if" and mine in (calc[2], calc[3]):
        if (test := free(calc[1])) is None:
            return None
        cond = cond & (truthy(test) if calc[3] == mine else ~truthy(test))
        calc = calc[2] if calc[3] == mine else calc[3]
    if not (isinstance(calc, list) and len(calc) == 3 and calc[0] in ("@max", "@min") and calc[1] == mine) or (x := free(calc[2])) is None or x.type == NULL:
        return None
    best = F.greatest if calc[0] == "@max" else F.least
    kind = common([x.type, start.type])
    return Composed(F.when(cond, x.col.cast(kind)), kind, F.lit(None), best, lambda made: made if start.type == NULL else best(made, start.col.cast(kind)), kind)


def affine(calc, mine: str, free: Callable[[object], Value | None], start: Value) -> Composed | None:
    """Sums, differences, products, new values, and conditions between such steps."""
    one, zero, same = F.lit(1), F.lit(0), F.lit(None).cast("boolean")

    def step(e) -> Step | None:
        if e == mine:
            return Step(one, zero, same, [])
        if (v := free(e)) is not None:
            return Step(zero, F.coalesce(v.col, zero), v.col.isNotNull(), [v.type], resets=v.const is None)
        if not isinstance(e, list) or not e:
            return None
        if e[0] == "@neg" and len(e) == 2 and (f := step(e[1])) is not None:
            return replace(f, a=-f.a, b=-f.b)
        if e[0] == "#if" and len(e) == 4 and (test := free(e[1])) is not None:
            f, g = step(e[2]), step(e[3])
            if f is None or g is None:
                return None
            either = lambda x, y: F.when(truthy(test), x).otherwise(y)
            return Step(either(f.a, g.a), either(f.b, g.b), either(f.known, g.known), f.types + g.types, f.factors or g.factors, f.resets or g.resets)
        if len(e) != 3 or e[0] not in ("@add", "@sub", "@mul"):
            return None
        left, right = free(e[1]), free(e[2])
        x, f = (right, step(e[1])) if left is None else (left, step(e[2]))
        if x is None or f is None:
            return None
        known, types = F.when(x.col.isNotNull(), True).otherwise(f.known), [*f.types, x.type]
        if e[0] == "@mul":
            by = F.coalesce(x.col, one)
            return Step(f.a * by, f.b * by, known, types, True, f.resets)
        by = F.coalesce(x.col, zero)
        if e[0] == "@add":
            return replace(f, b=f.b + by, known=known, types=types)
        return replace(f, b=f.b - by, known=known, types=types) if left is None else replace(f, a=-f.a, b=by - f.b, known=known, types=types)

    f = step(calc)
    if f is None:
        return None
    types = [t for t in [*f.types, start.type] if t != NULL]
    kind = common(types) if types else NULL
    if not all(is_number(t) for t in types) or kind == NULL or f.factors and (start.type == NULL or f.resets):
        return None  # a product with null is the other factor, which is no such step
    struct_type = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("known", T.BooleanType())])
    made = lambda a, b, known: F.struct(a.cast(kind).alias("a"), b.cast(kind).alias("b"), known.alias("known"))
    compose = lambda f, g: made(g["a"] * f["a"], g["a"] * f["b"] + g["b"], F.coalesce(g["known"], f["known"]))
    first = F.coalesce(start.col.cast(kind), zero.cast(kind))
    apply = lambda c: F.when(F.coalesce(c["known"], F.lit(start.type != NULL)), (c["a"] * first + c["b"]).cast(kind))
    return Composed(made(f.a, f.b, f.known), struct_type, made(one, zero, same), compose, apply, kind)


def source_filter(df: DataFrame, key: str, tests, value: Callable[[object], Value]) -> Column:
    """The filter of one ``querys`` entry on a source column; a null column never passes.

    Equalities of one key are alternatives; all other tests hold together.
    """
    name, _, as_ = key.partition("|")
    col = Value(F.col(f"`{name}`"), df.schema[name].dataType)
    kind = col.type

    def side(e) -> Column:
        v = value(e) if isinstance(e, list) or isinstance(e, str) and e[:1] in "@$" else literal(e)
        v = cast(v, as_) if as_ else v
        return v.col.cast(kind) if v.type != NULL else F.lit(None).cast(kind)

    tests = tests if isinstance(tests, dict) else {"==": tests}
    out, equal = col.col.isNotNull(), []
    for op, e in tests.items():
        if op in ("==", "in"):
            equal += [side(i) for i in (e if isinstance(e, list) and not (e and isinstance(e[0], str) and e[0].startswith("@")) else [e])]
        else:
            c = side(e)
            out = out & {">": col.col > c, ">=": col.col >= c, "<": col.col < c, "<=": col.col <= c, "!=": col.col != c}[op]
    return out & col.col.isin(equal) if equal else out
