"""A job: one input, lookups, one output, described by a document."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import config as configs
from weftline.functions import register_udf
from weftline.lang.values import NULL, truthy
from weftline.operators import shape
from weftline.plans.compiler import SEQ, Compiler, Fold, Windowed, source_filter
from weftline.plans.folds import fold_column, is_ordered, ordered_folds, window_column, window_states, with_arrival
from weftline.sinks import write
from weftline.sources import Catalog

STAGES = {"": "compiled", ">": "queried", ">>": "loaded", ">>>": "outputed", ">>>>": "finaled"}
MODES = {"I": "insert", "U": "update", "UI": "upsert", "UDI": "sync", "DI": "replace"}


def parse_table(text: str) -> tuple[str, list[str], str | None]:
    """(name, keys, mode or None) of ``<<&.db.table::a+b use UI``."""
    text = text.lstrip("<>").strip()
    text, _, mode = text.partition(" use ")
    name, _, keys = text.lstrip("&").lstrip(".").partition("::")
    return name.strip(), [k.partition("|")[0].strip() for k in keys.split("+")] if keys else [], mode.strip() or None


@dataclass
class Job:
    """A planned job; :meth:`plan` gives its output rows, :meth:`run` writes them."""

    spark: SparkSession
    config: dict
    catalog: Catalog
    arguments: dict[str, Any] = field(default_factory=dict)
    hooks: dict[str, list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)
    status: dict[str, Any] = field(default_factory=dict)
    _known: dict[str, str] | None = None

    @classmethod
    def from_config(cls, spark: SparkSession, config: dict | str, arguments: dict | None = None, catalog: Catalog | None = None) -> Job:
        loaded = configs.load(config) if isinstance(config, str) else configs.resolve(config)
        arguments = configs.arguments(loaded, arguments or {})
        loaded = configs.substitute(loaded, arguments)
        catalog = catalog or Catalog(spark)
        for db in loaded.get("databases", []):
            catalog.add(db)
        for name, fn in configs.imported(loaded.get("imports", {})).items():
            register_udf(name, fn, *configs.typing_of(fn))
        return cls(spark, loaded, catalog, arguments)

    def hook(self, stage: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """Add a function from rows to rows at ``queried``, ``loaded``, ``outputed`` or ``finaled``."""
        self.hooks.setdefault(stage, []).append(fn)

    def _steps(self, stage: str, df: DataFrame) -> DataFrame:
        for fn in self.hooks.get(stage, []):
            df = fn(df)
        now = "compiled"
        for step in self.config.get("pipelines", []):
            step = step if isinstance(step, list) else [step]
            marks = step[0][: len(step[0]) - len(step[0].lstrip(">"))]
            now = STAGES[marks] if marks else now
            if now == stage or (now == "compiled" and stage == "queried"):
                df = shape.transform(step[0].lstrip(">").lstrip("@"), df, [a for a in step[1:] if a != "$.*"])
        return df

    def compiler(self, df: DataFrame, name: str = "") -> Compiler:
        options = self.config.get("options", {})
        return Compiler(df, lambda n: self.catalog.read(n), set(options.get("unique", [])), self.config.get("defines"), self.config.get("variables"), self.states(), name, filtered=self.catalog.read_filtered, keyed=self.catalog.lookups.get)

    def states(self) -> dict[str, str]:
        """What the tables under ``states`` hold, as key and value; one that is not there yet holds nothing."""
        if self._known is None:
            self._known = dict(self.config.get("states_values") or {})
            for ref in self.config.get("states", []):
                try:
                    table = self.catalog.read(parse_table(ref)[0]).select("key", "value")
                except (AnalysisException, ValueError):
                    continue
                self._known |= {r["key"]: r["value"] for r in table.collect()}  # a job's own few counters
        return self._known

    def _keep_states(self, last: list | None) -> None:
        """The run's counters, and how far its cursor came, into the state tables."""
        if not self.config.get("states"):
            return
        kept = {k: v for k, v in self.status.items() if isinstance(v, (int, str))}
        if last is not None:
            kept["@cursor"] = last[0] if len(last) == 1 else json.dumps(last)
        rows = self.spark.createDataFrame(sorted((k, str(v)) for k, v in kept.items()), "key string, value string")
        for ref in self.config["states"]:
            write(self.catalog, parse_table(ref)[0], rows, "upsert", ["key"], [], lambda d: F.lit(True))
        self._known = None

    def cursor(self) -> list[tuple[str, str, bool]]:
        """(output field, source column, falling) of the cursor, most significant first: its own fields, then the output's keys that tell ties apart."""
        given, schema = self.config.get("cursor"), self.config.get("schema", "$.*")
        if given is None:
            return []
        orders = [(o if isinstance(o, list) else [o, False]) for o in self.config.get("orders", [])]
        falling = {n.removeprefix("$."): bool(down) for n, down in orders}
        keys = parse_table(self.config["output"])[1] if "output" in self.config else []
        out = []
        for name in dict.fromkeys([*([given] if isinstance(given, str) else given), *keys]):
            x = schema.get(name) if isinstance(schema, dict) else f"$.{name}"
            if not isinstance(x, str) or not x.startswith("$."):
                if name in keys and name != given:
                    continue  # a computed key cannot be looked for in the source
                raise ValueError(f"the cursor {name!r} is no source column")
            out.append((name, x.removeprefix("$."), falling.get(name, out[0][2] if out else False)))
        return out

    def _last(self) -> list | None:
        """Where the last run ended, as texts; None if there was none, or it is not to go on."""
        if not self.cursor() or not self.arguments.get("@recovery") or "@cursor" not in self.states():
            return None
        kept = self.states()["@cursor"]
        return json.loads(kept) if len(self.cursor()) > 1 and kept.startswith("[") else [kept]

    def _after_cursor(self, df: DataFrame) -> DataFrame:
        """With ``@recovery``, the rows past the one that the last run came to, by all fields of the cursor in turn.

        Its fields are bare source columns; a limited job thereby goes through its
        input page by page without offsets, and rows that tie in one field are told apart by the next.
        Null stands before every value, as in the orders of a job; behind, where the field falls.
        """
        last = self._last()
        if last is None:
            return df
        past, same = F.lit(False), F.lit(True)
        for (_, name, down), value in zip(self.cursor(), last, strict=False):
            if name not in df.columns:
                raise ValueError(f"the cursor {name!r} is no source column")
            col, at = F.col(f"`{name}`"), F.lit(value).cast(df.schema[name].dataType)
            if down:
                further = F.lit(False) if value is None else (col < at) | col.isNull()
            else:
                further = col.isNotNull() if value is None else col > at
            past = past | (same & further)
            same = same & col.eqNullSafe(at)
        _, first, down = self.cursor()[0]
        if last[0] is not None and not down:  # the files and databases can use this one
            df = df.where(F.col(f"`{first}`") >= F.lit(last[0]).cast(df.schema[first].dataType))
        return df.where(past)

    def _watched(self, df: DataFrame) -> tuple[DataFrame, Callable[[], list | None]]:
        """The rows, and what tells the last of them by the cursor once they are written."""
        found = self.cursor()
        if not found or not self.config.get("states"):
            return df, lambda: None
        if len({down for _, _, down in found}) > 1:
            raise ValueError("the fields of a cursor all rise or all fall")
        seen = Observation(f"cursor{uuid.uuid4().hex[:8]}")
        # null stands before every value, falling or not
        row = F.struct(*[F.struct(F.col(f"`{n}`").isNotNull().alias("k"), F.col(f"`{n}`").alias("v")).alias(f"c{i}") for i, (n, _, _) in enumerate(found)])
        best = (F.min if found[0][2] else F.max)(row)
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[best[f"c{i}"]["v"].cast("string").alias(f"c{i}") for i in range(len(found))])

        def last() -> list | None:
            got = seen.get
            return [got[f"c{i}"] for i in range(len(found))] if got["rows"] else None

        return df, last

    def source(self) -> DataFrame:
        """The input with its source filters; the catalogue may bind some of them as view arguments."""
        given = self.config["input"]
        if isinstance(given, list):  # literal rows
            rows = [r if isinstance(r, dict) else {"value": r} for r in given]
            names = list(dict.fromkeys(n for r in rows for n in r))
            df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names) if rows else self.spark.range(0).select()
            return self._filtered(df, configs.querys(self.config.get("querys", {}), self.arguments))
        tests = configs.querys(self.config.get("querys", {}), self.arguments)
        if given.lstrip("<& .").startswith("=@"):
            name, _, _ = given.lstrip("<& .=@").partition("::")
            df = self.catalog.call(name, self._request(tests))
        else:
            df, tests = self.catalog.read_filtered(parse_table(given)[0], tests)
        return self._filtered(df, tests)

    def _request(self, tests: dict) -> dict[str, Any]:
        """What a function that gives the input is told: the columns that the job reads (empty: all), its filters and orders, and where its last run ended."""
        schema = self.config.get("schema", "$.*")
        text = json.dumps([schema, self.config.get("predicate")])
        whole = schema == "$.*" or re.search(r'"\$+(\.\*)?[|"]', text) is not None
        fields = [] if whole else sorted(set(re.findall(r"\$+\.([A-Za-z_]\w*)", text)) | {k.partition("|")[0] for k in tests})
        last = self._last()
        orders = [(o if isinstance(o, list) else [o, False]) for o in self.config.get("orders", [])]
        return {"fields": fields, "filters": tests, "orders": [(n.removeprefix("$."), -1 if down else 1) for n, down in orders], "cursor": None if last is None else {n: v for (_, n, _), v in zip(self.cursor(), last, strict=False)}}

    def _filtered(self, df: DataFrame, tests: dict) -> DataFrame:
        constants = self.compiler(df)
        for key, test in tests.items():
            df = df.where(source_filter(df, key, test, lambda e: constants(e, [])))
        return self._after_cursor(df)

    def plan(self, source: DataFrame | None = None) -> DataFrame:
        """The rows of the job's output, before its sink."""
        df = self.source() if source is None else self._filtered(source, configs.querys(self.config.get("querys", {}), self.arguments))
        df = self._steps("queried", df)
        schema = self.config.get("schema", "$.*")
        if schema == "$.*":
            return self._finish(self._steps("loaded", self._ordered_source(df)), list(df.columns))
        text = json.dumps(schema)
        sequence = self.config.get("options", {}).get("sequence")
        if any(d in text for d in ("#aggregate", "#partition", "#assign")):
            df = with_arrival(df, sequence)
        compiler = self.compiler(df)
        if "predicate" in self.config:
            keep = truthy(compiler(self.config["predicate"], [compiler.root()]))
            compiler.df = compiler.df.where(keep)
        lists = [f[1] for f in schema.values() if isinstance(f, list) and f and isinstance(f[0], str) and f[0].partition("|")[0] == "#yield"]
        compiler.expand(lists)
        fields: dict[str, Any] = {}
        for name, x in schema.items():
            compiler.field = name.rstrip("?")
            fields[compiler.field] = compiler(x, [compiler.root()])
        df = self._ordered_source(compiler.df)
        out = self._folded(df, fields) if any(isinstance(v, Fold) for v in fields.values()) else self._selected(df, fields)
        return self._finish(self._steps("loaded", out), list(fields))

    def _ordered_source(self, df: DataFrame) -> DataFrame:
        orders = [o for o in self.config.get("orders", []) if (o[0] if isinstance(o, list) else o).split(".")[-1] not in (self.config.get("schema") or {})]
        names = [(o if isinstance(o, list) else [o, False]) for o in orders]
        keys = [(F.desc_nulls_last if down else F.asc_nulls_first)(n.removeprefix("$.")) for n, down in names if n.removeprefix("$.") in df.columns]
        return df.orderBy(*keys) if keys else df

    def _selected(self, df: DataFrame, fields: dict) -> DataFrame:
        arrival = F.col(SEQ) if SEQ in df.columns else F.lit(0)
        df, fields = self._stepped(df, fields, arrival)
        cols = []
        for name, v in fields.items():
            v = window_column(v, arrival) if isinstance(v, Windowed) else v
            v = v.one()
            cols.append((v.col.cast("string") if v.type == NULL else v.col).alias(name))
        return df.select(*cols)

    def _stepped(self, df: DataFrame, fields: dict, arrival) -> tuple[DataFrame, dict]:
        """Windows with a step of their own become columns of the rows first."""
        fields = dict(fields)
        for i, (name, w) in enumerate(fields.items()):
            if isinstance(w, Windowed) and w.kind == "steps":
                df, made = window_states(df, w, f"__win{i}", arrival)
                fields[name] = w.ret(made)
        return df, fields

    def _folded(self, df: DataFrame, fields: dict) -> DataFrame:
        """Groups: folds in order of arrival, first values of other fields; then windows over the groups."""
        folds = {n: v for n, v in fields.items() if isinstance(v, Fold)}
        key = next(iter(folds.values())).key
        if len({str(f.key.col._jc.toString()) for f in folds.values()}) > 1:
            raise ValueError("all aggregates of a job share one key")
        aggs, late = [F.min(SEQ).alias(SEQ)], {}
        ordered = {n: f for n, f in folds.items() if is_ordered(f)}
        for name, v in fields.items():
            if name in ordered:
                continue
            if isinstance(v, Fold):
                aggs.append(fold_column(v, name)[0].alias(name))
            elif isinstance(v, Windowed):
                parts = {"k": v.key.col, "v": v.value.col} | {f"o{i}": o.one().col for i, (o, _) in enumerate(v.order)}
                aggs += [F.min_by(c, SEQ).alias(f"__w_{name}_{p}") for p, c in parts.items()]
                late[name] = v
            else:
                aggs.append(F.min_by(v.one().col, SEQ).alias(name))
        grouped = df.groupBy(key.col.alias("__key")).agg(*aggs)
        if ordered:
            stepped = ordered_folds(df, key.col, ordered).withColumnRenamed("__key", "__group")
            grouped = grouped.join(stepped, F.col("__key").eqNullSafe(F.col("__group"))).drop("__group")
        for name, w in late.items():
            at = lambda p, name=name: F.col(f"__w_{name}_{p}")
            w.key = type(w.key)(at("k"), w.key.type)
            w.value = type(w.value)(at("v"), w.value.type)
            w.order = [(type(o)(at(f"o{i}"), o.one().type), d) for i, (o, d) in enumerate(w.order)]
        grouped, made = self._stepped(grouped, late, F.col(SEQ))
        cols = []
        for name in fields:
            v = made.get(name)
            v = window_column(v, F.col(SEQ)) if isinstance(v, Windowed) else v
            cols.append(F.col(f"`{name}`") if v is None else v.one().col.alias(name))
        if "orders" not in self.config and "output" in self.config and parse_table(self.config["output"])[0].startswith("stdio."):
            grouped = grouped.orderBy(SEQ)  # printed groups come as they were first seen
        return grouped.select(*cols)

    def _finish(self, df: DataFrame, names: list[str]) -> DataFrame:
        if "intercept" in self.config:
            df = df.where(_all(_bounds(df, self.config["intercept"])))
            compiler = self.compiler(df)
            keep = truthy(compiler(self.config["intercept"], [compiler.root()]))
            df = compiler.df.where(keep).select(*[F.col(f"`{n}`") for n in df.columns])
        orders = [(o if isinstance(o, list) else [o, False]) for o in self.config.get("orders", [])]
        if not orders and self.arguments.get("@limit", self.config.get("limit")):
            orders = [[n, down] for n, _, down in self.cursor()]
        keys = [(F.desc_nulls_last if down else F.asc_nulls_first)(n.removeprefix("$.")) for n, down in orders if n.removeprefix("$.") in df.columns]
        if keys:
            named = {n.removeprefix("$.") for n, _ in orders}
            ties = [(n, down) for n, _, down in self.cursor() if n not in named and n in df.columns]
            keys += [(F.desc_nulls_last if down else F.asc_nulls_first)(n) for n, down in ties]
            named |= {n for n, _ in ties}
            if self.arguments.get("@primary_order", True) and "output" in self.config:
                keys += [F.asc_nulls_first(k) for k in parse_table(self.config["output"])[1] if k in df.columns and k not in named]
            df = df.orderBy(*keys)
        limit = self.arguments.get("@limit", self.config.get("limit"))
        offset = self.config.get("offset")
        if offset:
            df = df.offset(int(offset))
        if limit:
            df = df.limit(int(limit))
        return df.drop(*[n for n in df.columns if n.startswith("__") and n.endswith("__")])

    def run(self, source: DataFrame | None = None, batch: str | None = None) -> dict[str, Any]:
        """Write the rows to the output; gives what the run did.

        A ``batch`` that has a name is appended to files once: a run that repeats it finds its mark
        and writes nothing.  Jobs that go on behind a cursor name each page by where it begins.
        """
        df = self._steps("outputed", self.plan(source))
        name, keys, mode = parse_table(self.config["output"])
        neutral = [n.rstrip("?") for n in (self.config["schema"] if isinstance(self.config.get("schema"), dict) else {}) if n.endswith("?")]
        scope = self._scope()
        paged = batch is None
        if paged and self.cursor() and self.arguments.get("@recovery") and self.config.get("states"):
            batch = "page-" + hashlib.sha1(json.dumps([self.config.get("name"), self.config["input"], self._last()]).encode()).hexdigest()
        watched, last = self._watched(df)
        self.status = write(self.catalog, name, watched, MODES.get(mode or "UDI", mode or "sync"), keys, neutral, scope, batch=batch, note=last, empty=paged)
        at = self.status.pop("note", None)
        self._keep_states(at)
        self._steps("finaled", df)
        return self.status

    def _scope(self):
        """The source filters as filters on the output, for fields that are a bare source column."""
        schema = self.config.get("schema")
        tests = configs.querys(self.config.get("querys", {}), self.arguments)
        out = {}
        for key, test in tests.items():
            name = key.partition("|")[0]
            for target, x in schema.items() if isinstance(schema, dict) else ((name, f"$.{name}"),):
                if isinstance(x, str) and x.partition("|")[0] == f"$.{name}":
                    out[target.rstrip("?")] = test
        constants = Compiler(self.spark.range(1), lambda n: None)
        return lambda df: _all([source_filter(df, k, t, lambda e: constants(e, [])) for k, t in out.items() if k in df.columns])


def _bounds(df: DataFrame, x) -> list:
    """What a test implies of whole numbers, as plain comparisons.

    Of a place in a window, Spark sees by these how many rows of a key are asked for, and keeps no more of each task's.
    Null stands before every value, so what may be null passes; the test itself follows.
    """
    if not isinstance(x, list) or len(x) < 3 or not isinstance(x[0], str):
        return []
    if x[0] == "@and":
        return [c for part in x[1:] for c in _bounds(df, part)]
    turned = {"@gte": "@lte", "@gt": "@lt", "@eq": "@eq"}
    head, name, most = (turned.get(x[0]), x[2], x[1]) if isinstance(x[1], int) else x[:3]
    name = name.removeprefix("$.") if isinstance(name, str) and name.startswith("$.") else None
    if len(x) != 3 or name not in df.columns or df.schema[name].dataType != T.LongType() or isinstance(most, bool) or not isinstance(most, int) or not 0 < most < 1 << 31:
        return []
    col = F.col(f"`{name}`")
    return {"@lte": [(col <= most) | col.isNull()], "@lt": [(col < most) | col.isNull()], "@eq": [col == most]}.get(head, [])


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def run_all(jobs: list[Job]) -> list[dict]:
    """Jobs in order; a later job sees what an earlier one has written."""
    return [j.run() for j in jobs]


