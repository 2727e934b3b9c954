"""The library's queries over the test tables: jobs, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import merged
from weftline.operators.asof import asof_join
from weftline.plans.job import Job
from weftline.shared import local_folder, shared_folder
from weftline.sinks import apply_mode, write
from weftline.sources import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plan(spark: SparkSession, sf_dir: str, config: dict, catalog: Catalog | None = None) -> DataFrame:
    """The rows of a job whose database ``t`` holds the test tables."""
    base = {"databases": [{"name": "t", "driver": "parquet", "path": sf_dir}]}
    return Job.from_config(spark, merged(base, config), catalog=catalog).plan()


def job(name: str, sql: str | None, table: str, schema, **more) -> None:
    config = {"input": f"&.t.{table}", "schema": schema} | more
    QUERIES[name] = lambda spark, sf_dir: plan(spark, sf_dir, config)
    if sql is not None:
        SQL[name] = sql


def query(name: str, sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


# --- projections and filters -------------------------------------------------------------------

job("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders", "orders", {"o_orderkey": "$.o_orderkey", "o_custkey": "$.o_custkey", "o_totalprice": "$.o_totalprice"})
job("filter_ops", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW')", "orders", {"o_orderkey": "$.o_orderkey", "o_totalprice": "$.o_totalprice"}, querys={"o_totalprice": {">=": 1000}, "o_orderstatus": {"!=": "P"}, "o_orderpriority": {"in": ["1-URGENT", "5-LOW"]}})
job("filter_eq_merge", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')", "orders", {"o_orderkey": "$.o_orderkey", "o_orderstatus": "$.o_orderstatus"}, querys={"o_orderstatus": {"==": ["F", "O"]}})
job("predicate_truthy", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <> 0 AND c_acctbal <> 0", "customer", {"c_custkey": "$.c_custkey", "c_acctbal": "$.c_acctbal"}, predicate=["@and", "$.c_custkey", "$.c_acctbal"])
_N5 = ["#if", ["@eq", "$.c_nationkey", 5], None, "$.c_nationkey"]
job(
    "null_safe_cmp",
    """SELECT c_custkey, CAST(CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE 0 END AS BIGINT) AS eq_zero, CAST(CASE WHEN coalesce(n, 0) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS gt_null,
    CAST(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE CASE WHEN n > 7 THEN 1 ELSE 0 END END AS BIGINT) AS gt_seven, CAST(CASE WHEN b <> 0 THEN 1 ELSE 0 END AS BIGINT) AS beats_zero
    FROM (SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN NULL ELSE c_nationkey END AS n, c_acctbal AS b FROM customer)""",
    "customer",
    {"c_custkey": "$.c_custkey", "eq_zero": ["@eq", _N5, 0], "gt_null": ["@gt", _N5, None], "gt_seven": ["@gt", _N5, 7], "beats_zero": ["@gt", "$.c_acctbal", 0]},
)
job(
    "arith_null_identity",
    """SELECT c_custkey, coalesce(n + 1, 1) AS plus, CASE WHEN n IS NULL THEN -c_acctbal ELSE n - c_acctbal END AS minus, coalesce(n * 3, 3) AS times, CASE WHEN n IS NULL THEN c_custkey ELSE n + c_custkey END AS both
    FROM (SELECT *, CAST(CASE WHEN c_nationkey = 5 THEN NULL ELSE c_nationkey END AS BIGINT) AS n FROM customer)""",
    "customer",
    {"c_custkey": "$.c_custkey", "plus": ["@add", _N5, 1], "minus": ["@sub", _N5, "$.c_acctbal"], "times": ["@mul", _N5, 3], "both": ["@add", _N5, "$.c_custkey"]},
)
job(
    "div_mod_zero",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_quantity / l_discount END AS ratio, CAST(l_partkey % l_linenumber AS BIGINT) AS rest, CAST(((-l_partkey % 7) + 7) % 7 AS BIGINT) AS floor_rest FROM lineitem",
    "lineitem",
    {"l_orderkey": "$.l_orderkey", "l_linenumber": "$.l_linenumber|int", "ratio": ["@div", "$.l_quantity", "$.l_discount"], "rest": ["@mod", "$.l_partkey", "$.l_linenumber"], "floor_rest": ["@mod", ["@neg", "$.l_partkey"], 7]},
)
SQL["div_mod_zero"] = SQL["div_mod_zero"].replace("l_orderkey, l_linenumber,", "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,")
job(
    "bit_ops",
    "SELECT p_partkey, CAST(CASE WHEN s = 0 THEN 0 ELSE p_partkey & s END AS BIGINT) AS b_and, CAST(CASE WHEN s = 0 THEN 0 ELSE p_partkey | s END AS BIGINT) AS b_or, CAST(CASE WHEN s = 0 THEN 0 ELSE xor(p_partkey, s) END AS BIGINT) AS b_xor, CAST(p_partkey << 3 AS BIGINT) AS b_left, CAST(p_partkey >> 2 AS BIGINT) AS b_right, -p_partkey - 1 AS b_not FROM (SELECT p_partkey, CAST(p_size % 4 AS BIGINT) AS s FROM part)",
    "part",
    {"p_partkey": "$.p_partkey", **{n: ["@bit", op, "$.p_partkey", ["@mod", "$.p_size", 4]] for n, op in (("b_and", "&"), ("b_or", "|"), ("b_xor", "^"))}, "b_left": ["@bit", "<<", "$.p_partkey", 3], "b_right": ["@bit", ">>", "$.p_partkey", 2], "b_not": ["@bit", "~", "$.p_partkey"]},
)
job("bool_value_ops", "SELECT c_custkey, CAST(CASE WHEN c_nationkey = 0 THEN 0 ELSE c_custkey END AS BIGINT) AS both, CAST(CASE WHEN c_nationkey <> 0 THEN c_nationkey ELSE c_custkey END AS BIGINT) AS either FROM customer", "customer", {"c_custkey": "$.c_custkey", "both": ["@and", "$.c_nationkey", "$.c_custkey"], "either": ["@or", "$.c_nationkey", "$.c_custkey"]})
job("if_else", "SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN 'done' END AS done FROM orders", "orders", {"o_orderkey": "$.o_orderkey", "size": ["#if", ["@gt", "$.o_totalprice", 50000], "big", "small"], "done": ["#if", ["@eq", "$.o_orderstatus", "F"], "done"]})
job("case_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other ' || o_orderstatus END AS status FROM orders", "orders", {"o_orderkey": "$.o_orderkey", "status": {"#case": "$.o_orderstatus", "F": "finished", "O": "open", "#end": ["@add", "other ", "$.o_orderstatus"]}})
job("case_int", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 3 THEN 'three' ELSE 'many' END AS word FROM nation", "nation", {"n_nationkey": "$.n_nationkey", "word": {"#case": "$.n_regionkey", ":0": "zero", ":3": "three", "#end": "many"}})
job("match_regex", "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'high' WHEN regexp_matches(o_orderpriority, '^(\\d)-(.*)') THEN regexp_extract(o_orderpriority, '^(\\d)-(.*)', 2) ELSE '' END AS level FROM orders", "orders", {"o_orderkey": "$.o_orderkey", "level": {"#match": "$.o_orderpriority", "/[12]/": "high", "/(\\d)-(.*)/": "$.match_groups.:1", "#end": ""}})
job("match_set", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS kind FROM customer", "customer", {"c_custkey": "$.c_custkey", "kind": {"#match": "$.c_mktsegment", '["BUILDING", "MACHINERY"]': "heavy", "#end": "light"}})
job(
    "match_nested",
    "SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'M%' THEN 'set' WHEN c_mktsegment = 'BUILDING' THEN 'map5' ELSE 'none' END AS kind, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0::BIGINT WHEN 'FURNITURE' THEN 1::BIGINT END AS place FROM customer",
    "customer",
    {"c_custkey": "$.c_custkey", "kind": {"#match": "$.c_mktsegment", '("/A.*/", "/m/i")': "set", '{"BUILDING": 5}': ["@add", "map", "$.match_value|str"], "[BUILDING, FURNITURE]": "never", "#end": "none"}, "place": {"#match": "$.c_mktsegment", '["HOUSEHOLD", "FURNITURE"]': "$.match_key", "#end": None}},
)
job("match_range", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size >= 10 AND p_size < 30 THEN 'M' ELSE 'L' END AS size FROM part WHERE p_size <> 0", "part", {"p_partkey": "$.p_partkey", "size": {"#match": "$.p_size", "<10": "S", ">=10,<30": "M", "#end": "L"}}, querys={"p_size": {"!=": 0}})
job("make_struct_let", "SELECT c_custkey, c_name AS name, c_mktsegment AS picked, c_acctbal * 2 AS twice FROM customer", "customer", {"c_custkey": "$.c_custkey", "name": ["#make", {"n": "$.c_name", "m": "$.c_mktsegment"}, ":$.n"], "picked": ["#let", ["@add", "c_mkt", "segment"]], "twice": ["#make", {"a": "$.c_acctbal"}, [":@mul", "$.a", 2]]})
job("call_define", "SELECT o_orderkey, o_totalprice * 0.9::DOUBLE AS net, upper(o_orderstatus) AS u FROM orders", "orders", {"o_orderkey": "$.o_orderkey", "net": ["#call", "net", "$.o_totalprice"], "u": ["#call", "up", "$.o_orderstatus"]}, defines={"net": ["@mul", "$", 0.9], "up": ["@string::upper", "$"]})
job("scope_inherit", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '/' || r_name || '/' || n_nationkey AS path FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", "nation", {"n_nationkey": "$.n_nationkey", "path": ["$.n_regionkey", "&.t.region::r_regionkey", [":@add", "$$.n_name", "/", "$.r_name", "/", "$$.n_nationkey"]]}, options={"unique": ["t.region"]})

# --- lookups ---------------------------------------------------------------------------------------

_ONE = {"unique": ["t.nation", "t.region", "t.customer", "t.orders", "t.supplier", "t.part"]}
_NATION = ["$.c_nationkey", "&.t.nation::n_nationkey"]
job("lookup_1_1", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", "customer", {"c_custkey": "$.c_custkey", "n_name": [*_NATION, ":$.n_name"]}, options=_ONE)
job("lookup_chain3", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", "orders", {"o_orderkey": "$.o_orderkey", "c_name": ["$.o_custkey", "&.t.customer::c_custkey", ":$.c_name"], "n_name": ["$.o_custkey", "&.t.customer::c_custkey", [":$.c_nationkey", "&.t.nation::n_nationkey", ":$.n_name"]], "r_name": ["$.o_custkey", "&.t.customer::c_custkey", [":$.c_nationkey", "&.t.nation::n_nationkey", [":$.n_regionkey", "&.t.region::r_regionkey", ":$.r_name"]]]}, options=_ONE)
job("lookup_composite", "SELECT a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber, b.l_quantity AS q FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber, any_value(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", "lineitem", {"l_orderkey": "$.l_orderkey", "l_linenumber": "$.l_linenumber", "q": [["$.l_orderkey", "$.l_linenumber"], "&.t.lineitem::l_orderkey+l_linenumber", ["@if", 1]]})
QUERIES["lookup_composite"] = lambda spark, sf_dir: plan(spark, sf_dir, {"input": "&.t.lineitem", "schema": {"l_orderkey": "$.l_orderkey", "l_linenumber": "$.l_linenumber", "n": [["$.l_orderkey", "$.l_linenumber"], "&.t.lineitem::l_orderkey+l_linenumber", [":@sum", "$.*", "l_quantity"]]}})
SQL["lookup_composite"] = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem"
job("lookup_cast_key", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON CAST(c_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR)", "customer", {"c_custkey": "$.c_custkey", "n_name": [["@add", "$.c_nationkey|str", ""], "&.t.nation::n_nationkey", ":$.n_name"]}, options=_ONE)
job("lookup_unmatched", "SELECT o_orderkey, coalesce(q, 0) AS q FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey", "orders", {"o_orderkey": "$.o_orderkey", "q": ["$.o_orderkey", "&.t.lineitem::l_orderkey", [":@sum", "$.*", "l_quantity"]]})
job("lookup_list_names", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, coalesce(names, '') AS names FROM region LEFT JOIN (SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1) ON r_regionkey = n_regionkey", "region", {"r_regionkey": "$.r_regionkey", "names": ["$.r_regionkey", "&.t.nation::n_regionkey", [":@join", ["@sort", "$.n_name"], ","]]})
job("lookup_expand", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "customer", {"c_custkey": "$.c_custkey", "o_orderkey": ["$.c_custkey", "&&.t.orders::o_custkey", ":$.o_orderkey"]})
job("lookup_filtered", "SELECT c_custkey, coalesce(total, 0) AS total FROM (SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey", "customer", {"c_custkey": "$.c_custkey", "total": ["$.c_custkey", ["&.t.orders::o_custkey", {"o_orderstatus": "F"}], [":@sum", "$.*", "o_totalprice"]]})
_TOTAL = QUERIES["lookup_filtered"]
QUERIES["lookup_filtered"] = lambda spark, sf_dir: _TOTAL(spark, sf_dir).withColumn("total", F.round("total", 2))
job("lookup_theta", "SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate", "orders", {"o_orderkey": "$.o_orderkey", "l_linenumber": ["$.o_orderkey", "&&.t.lineitem::l_orderkey", ["@gte", "$.l_shipdate", "$$.o_orderdate"], ":$.l_linenumber"]})
_DAY = ["@and", ["@gte", "$.ts", ["@time_window", "1d", "$$.ts"]], ["@lt", "$.ts", "$$.ts"]]
job(
    "lookup_range",
    """SELECT a.event_id, max(b.event_id) AS latest, coalesce(string_agg(b.event_id, ',' ORDER BY b.event_id), '') AS ids, round(coalesce(sum(b.value), 0), 4) AS total FROM events a
    LEFT JOIN events b ON b.user_id = a.user_id AND b.ts >= date_trunc('day', a.ts) AND b.ts < a.ts GROUP BY 1""",
    "events",
    {"event_id": "$.event_id", "latest": ["$.user_id", "&.t.events::user_id", _DAY, [":@max", "$.event_id"]], "ids": ["$.user_id", "&.t.events::user_id", _DAY, [":@join", ["@sort", "$.event_id"], ","]], "total": ["$.user_id", "&.t.events::user_id", _DAY, [":@sum", "$.*", "value"]]},
)
_RANGE = QUERIES["lookup_range"]
QUERIES["lookup_range"] = lambda spark, sf_dir: _RANGE(spark, sf_dir).withColumn("total", F.round("total", 4))
job("lookup_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", {"c_custkey": "$.c_custkey"}, predicate=["@gt", ["$.c_custkey", "&.t.orders::o_custkey", [":@sum", "$.*", "o_totalprice"]], 0])
job("lookup_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", {"c_custkey": "$.c_custkey"}, predicate=["@eq", ["$.c_custkey", "&.t.orders::o_custkey", [":@sum", "$.*", "o_totalprice"]], 0])
job("lookup_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders", {"o_orderkey": "$.o_orderkey", "c_name": ["$.o_custkey", "&.t.customer::c_custkey", ":$.c_name"]}, options=_ONE, intercept=["@not", ["@is_null", "$.c_name"]])
job("load_scalar", "SELECT n_nationkey::BIGINT AS n_nationkey, (SELECT max(c_acctbal) FROM customer) AS top FROM nation", "nation", {"n_nationkey": "$.n_nationkey", "top": ["&.t.customer::c_custkey", [":@max", "$.c_acctbal"]]})
job("lookup_argmax", "SELECT c_custkey, k FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey", "customer", {"c_custkey": "$.c_custkey", "k": ["$.c_custkey", "&.t.orders::o_custkey", [":@max", "$.*|array", "o_totalprice", ":$.o_orderkey"]]})
job("lookup_array_key", "SELECT n_nationkey::BIGINT AS n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) || ',' || (SELECT r_name FROM region WHERE r_regionkey = (n_regionkey + 1) % 5) AS names FROM nation", "nation", {"n_nationkey": "$.n_nationkey", "names": [["@make", "$.n_regionkey", ["@mod", ["@add", "$.n_regionkey", 1], 5]], "&.t.region::r_regionkey", [":@join", "$.r_name", ","]]})


@query("asof_latest_event", "SELECT a.event_id, b.event_id AS asof_event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN LATERAL (SELECT event_id, value FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'click' AND e.ts < a.ts ORDER BY ts DESC, event_id DESC LIMIT 1) b ON true")
def asof_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bought, clicked = events.where("event_type = 'purchase'"), events.where("event_type = 'click'")
    return asof_join(bought.select("event_id", "user_id", "ts"), clicked, ["user_id"], "ts", "ts", ["event_id", "value"], ties=["event_id"]).select("event_id", "asof_event_id", "asof_value")


# --- folds -------------------------------------------------------------------------------------------

_FLAGS = ["@add", "$.l_returnflag", "$.l_linestatus"]


def _agg(calc):
    return ["#aggregate", _FLAGS, calc]


job(
    "agg_count_sum_min_max",
    "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2",
    "lineitem",
    {"flag": "$.l_returnflag", "status": "$.l_linestatus", "n": _agg(["@add", "$.n", 1]), "s": _agg(["@add", "$.s", "$$.l_quantity"]), "lo": _agg(["@min", "$.lo", "$$.l_extendedprice"]), "hi": _agg(["@max", "$.hi", "$$.l_extendedprice"])},
)


@query("agg_avg_two_field", "SELECT l_returnflag AS flag, round(sum(l_quantity) / count(*), 6) AS average FROM lineitem GROUP BY 1")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(spark, sf_dir, {"input": "&.t.lineitem", "schema": {"flag": "$.l_returnflag", "n": ["#aggregate", "$.l_returnflag", ["@add", "$.n", 1]], "s": ["#aggregate", "$.l_returnflag", ["@add", "$.s", "$$.l_quantity"]]}})
    return out.select("flag", F.round(F.col("s") / F.col("n"), 6).alias("average"))


_USER = {"sequence": "event_id"}
job("agg_first_last", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1", "events", {"user_id": "$.user_id", "first_type": "$.event_type", "last_type": ["#aggregate", "$.user_id", "$$.event_type"]}, options=_USER)
job("agg_cond_last", "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS last_value FROM events GROUP BY 1", "events", {"user_id": "$.user_id", "last_value": ["#aggregate", "$.user_id", {"#case": "$$.event_type", "purchase": "$$.value", "#end": "$.last_value"}]}, options=_USER)


@query("agg_collect", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY 1")
def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(spark, sf_dir, {"input": "&.t.events", "schema": {"user_id": "$.user_id", "types": ["#aggregate", "$.user_id", ["@array::append", "$.types", "$$.event_type"]]}, "options": _USER})
    return out.select("user_id", F.array_join("types", ",").alias("types"))


job("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", "orders", {"o_custkey": "$.o_custkey", "n": ["#aggregate", "$.o_custkey", ["@add", "$.n", 1]]}, intercept=["@gt", "$.n", 12])
job("agg_distinct", "SELECT DISTINCT p_brand, p_type FROM part", "part", {"p_brand": ["#aggregate", ["@add", "$.p_brand", "/", "$.p_type"], "$$.p_brand"], "p_type": "$.p_type"})
job("agg_global", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders", "orders", {"n": ["#aggregate", "all", ["@add", "$.n", 1]], "top": ["#aggregate", "all", ["@max", "$.top", "$$.o_totalprice"]]})
job("agg_sum_if", "SELECT user_id, coalesce(sum(CASE WHEN value > 50 THEN 1 END), NULL)::BIGINT AS n FROM events GROUP BY 1", "events", {"user_id": "$.user_id", "n": ["#aggregate", "$.user_id", ["#if", ["@gt", "$$.value", 50], ["@add", "$.n", 1], "$.n"]]})
job("agg_generic_fold", "SELECT user_id, CAST(list_reduce(list_prepend(0::BIGINT, list(event_id ORDER BY event_id)), lambda acc, x: (acc * 3 + x) % 1000003) AS BIGINT) AS h FROM events GROUP BY 1", "events", {"user_id": "$.user_id", "h": ["#aggregate", "$.user_id", ["@mod", ["@add", ["@mul", ["@add", "$.h", 0], 3], "$$.event_id"], 1000003]]}, options=_USER)

# --- windows ------------------------------------------------------------------------------------------

_ORD = {"valuer": "$.event_id", "orders": [["event_id", False]]}


def _win(name: str, function: str, calc, value="$.value", order=_ORD, kind: str | None = None) -> None:
    job(name, f"SELECT event_id, {function} AS x FROM events", "events", {"event_id": "$.event_id", "x": ["#partition", "$.user_id", order, value, calc]}, options=_USER)
    if kind == "round":
        inner = QUERIES[name]
        QUERIES[name] = lambda spark, sf_dir: inner(spark, sf_dir).withColumn("x", F.round("x", 4))
        SQL[name] = f"SELECT event_id, round({function}, 4) AS x FROM events"


_OVER = "OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
_win("win_total", "max(value) OVER (PARTITION BY user_id)", ["@max", "$.state", "$.value"], order=None)
_win("win_running_sum", f"sum(value) {_OVER}", ["@add", "$.state", "$.value"], kind="round")
_win("win_running_max", f"max(value) {_OVER}", ["@max", "$.state", "$.value"])
_win("win_running_count", f"count(*) {_OVER}", ["@add", "$.state", 1])
_win("win_row_number", "row_number() OVER (PARTITION BY user_id ORDER BY event_id)", ["@add", "$.context.current_index", 1])
_win("win_lag", "lag(value) OVER (PARTITION BY user_id ORDER BY event_id)", ["@lag", 1])
_win("win_lead", "lead(value, 2) OVER (PARTITION BY user_id ORDER BY event_id)", ["@lead", 2])
_win("win_rank", "rank() OVER (PARTITION BY user_id ORDER BY event_type)", ["@rank"], order={"valuer": "$.event_type", "orders": [["event_type", False]]})
_win("win_generic", f"CAST(list_reduce(list_prepend(0::BIGINT, list(event_id) {_OVER}), lambda acc, x: (acc * 2 + x) % 9973) AS BIGINT)", ["@mod", ["@add", ["@mul", ["@add", "$.state", 0], 2], "$.value"], 9973], value="$.event_id")
job("win_topk_qualify", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem QUALIFY rn <= 3", "lineitem", {"l_orderkey": "$.l_orderkey", "l_linenumber": "$.l_linenumber", "rn": ["#partition", "$.l_returnflag", {"valuer": "$.l_extendedprice", "orders": [["p", True]]}, "$.l_quantity", ["@add", "$.context.current_index", 1]]}, intercept=["@lte", "$.rn", 3])


@query("win_topk_qualify", SQL["win_topk_qualify"])
def win_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    catalog = Catalog(spark)
    catalog.put("m.items", items)
    schema = {"l_orderkey": "$.l_orderkey", "l_linenumber": "$.l_linenumber", "rn": ["#partition", "$.l_returnflag", {"valuer": "$.l_extendedprice", "orders": [["p", True]]}, "$.l_quantity", ["@add", "$.context.current_index", 1]]}
    return plan(spark, sf_dir, {"input": "&.m.items", "schema": schema, "intercept": ["@lte", "$.rn", 3], "options": {"sequence": "seq"}}, catalog)


job("win_after_agg", "SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)", "orders", {"o_custkey": "$.o_custkey"})


@query("win_after_agg", SQL["win_after_agg"].replace("(ORDER BY n DESC)", "(PARTITION BY n % 3 ORDER BY n DESC)"))
def win_after_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    catalog.put("m.counts", plan(spark, sf_dir, {"input": "&.t.orders", "schema": {"o_custkey": "$.o_custkey", "n": ["#aggregate", "$.o_custkey", ["@add", "$.n", 1]]}}))
    return plan(spark, sf_dir, {"input": "&.m.counts", "schema": {"o_custkey": "$.o_custkey", "n": "$.n", "r": ["#partition", ["@mod", "$.n", 3], {"valuer": "$.n", "orders": [["n", True]]}, "$.n", ["@rank"]]}}, catalog)


# --- rows in and out ----------------------------------------------------------------------------------

_WORDS = ["@substring", ["@split", "$.p_name", " "], 0, 5]
job("yield_basic", "SELECT p_partkey, unnest(string_split(p_name, ' ')[1:5]) AS word FROM part", "part", {"p_partkey": "$.p_partkey", "word": ["#yield", _WORDS]})
_EVEN = ["#if", ["@eq", ["@mod", "$.p_partkey", 2], 0], ["@range", ["@mod", "$.p_size", 4]], ["@range", 0]]
job("yield_empty", "SELECT p_partkey, CAST(unnest(CASE WHEN p_partkey % 2 = 0 THEN range(0, p_size % 4) ELSE [] END) AS BIGINT) AS i FROM part", "part", {"p_partkey": "$.p_partkey", "i": ["#yield", _EVEN]})
job("yield_zip", "SELECT p_partkey, i AS a, CASE WHEN i < 2 THEN i + 10 END AS b FROM (SELECT p_partkey, unnest(range(0, 2 + p_partkey % 3)) AS i FROM part)", "part", {"p_partkey": "$.p_partkey", "a": ["#yield", ["@range", ["@add", 2, ["@mod", "$.p_partkey", 3]]]], "b": ["#yield", ["@range", 10, 12]]})
job("yield_nested", "SELECT r_regionkey::BIGINT AS r_regionkey, i * 10 + j AS x FROM (SELECT r_regionkey, unnest(range(0, 3)) AS i FROM region), (SELECT unnest(range(0, 2)) AS j)", "region", {"r_regionkey": "$.r_regionkey", "x": ["#yield", ["@range", 3], [":#yield", ["@range", 2], [":@add", ["@mul", "$$.*", 10], "$.*"]]]})
_LIST = ["@range", ["@mod", "$.p_size", 7]]
job("foreach_map", "SELECT p_partkey, array_to_string(list_transform(range(0, p_size % 7), lambda i: i * i), ',') AS squares FROM part", "part", {"p_partkey": "$.p_partkey", "squares": ["#foreach", _LIST, ["@mul", "$._value_", "$._value_"], [":@join", "$.*", ","]]})
job("foreach_continue", "SELECT p_partkey, array_to_string(list_filter(range(0, p_size % 7), lambda i: i % 2 = 0), ',') AS even FROM part", "part", {"p_partkey": "$.p_partkey", "even": ["#foreach", _LIST, ["#if", ["@mod", "$._value_", 2], "#continue", "$._value_"], [":@join", "$.*", ","]]})
job("foreach_break", "SELECT p_partkey, array_to_string(list_filter(range(0, p_size % 7), lambda i: i < 3), ',') AS head FROM part", "part", {"p_partkey": "$.p_partkey", "head": ["#foreach", _LIST, ["#if", ["@gte", "$._value_", 3], "#break", "$._value_"], [":@join", "$.*", ","]]})


def _shape(name: str, sql: str, table: str, steps: list, columns: list[str]) -> None:
    SQL[name] = sql
    QUERIES[name] = lambda spark, sf_dir: plan(spark, sf_dir, {"input": f"&.m.{table}", "schema": "$.*", "pipelines": steps}, _memory(spark, sf_dir, table, columns))


def _memory(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> Catalog:
    catalog = Catalog(spark)
    catalog.put(f"m.{table}", spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns))
    return catalog


_shape("unpivot_v4h", "SELECT s_suppkey, 'a' AS k, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal * 2 FROM supplier", "supplier", [[">@transform::v4h", "$.*", "k", "v", ["s_suppkey"]]], ["s_suppkey", "s_acctbal AS a", "s_acctbal * 2 AS b"])
_shape("unpivot_h2v", "SELECT s_suppkey, 'a' AS k, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal * 2 FROM supplier", "supplier", [[">@transform::h2v", "$.*", "s_suppkey", "k", "v"]], ["s_suppkey", "s_acctbal AS a", "s_acctbal * 2 AS b"])
_STATUS = ["F", "O", "P"]
_shape("pivot_v2h_sum", "SELECT o_orderpriority AS prio, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 END), 0) AS BIGINT) AS {s}" for s in _STATUS) + " FROM orders GROUP BY 1", "orders", [[">@transform::v2h", "$.*", "s", "prio", "one"]], ["o_orderpriority AS prio", "o_orderstatus AS s", "1L AS one"])
_shape("pivot_v2h_count", "SELECT o_orderpriority AS prio, " + ", ".join(f"count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS {s}" for s in _STATUS) + " FROM orders GROUP BY 1", "orders", [[">@transform::v2h", "$.*", "s", "prio"]], ["o_orderpriority AS prio", "o_orderstatus AS s"])
_shape("pivot_h4v", "SELECT id, max(CASE WHEN k = 'a' THEN v END) AS a, max(CASE WHEN k = 'b' THEN v END) AS b FROM (SELECT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS k, max(o_orderkey) AS v FROM orders GROUP BY 1, 2) GROUP BY 1", "orders", [[">@transform::h4v", "$.*", "k", "v", "id"]], ["o_custkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS k", "o_orderkey AS v"])


@query("pivot_h4v", SQL["pivot_h4v"])
def pivot_h4v(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kv = orders.groupBy(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("k")).agg(F.max("o_orderkey").alias("v"))
    catalog.put("m.kv", kv.withColumn("at", F.concat_ws("/", F.lpad(F.col("id").cast("string"), 12, "0"), "k")))
    return plan(spark, sf_dir, {"input": "&.m.kv", "schema": "$.*", "pipelines": [[">@transform::h4v", "$.*", "k", "v", "id", None, "at"]]}, catalog)


_shape("pivot_uniqkv", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS o_orderkey, " + ", ".join(f"coalesce(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 END), 0)::BIGINT AS {s}" for s in _STATUS) + " FROM orders GROUP BY 1", "orders", [[">@transform::uniqkv", "$.*", "o_custkey", "o_orderstatus", "one", "o_orderkey"]], ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "1L AS one"])
job("sort_multi_limit", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 25", "orders", {"o_orderkey": "$.o_orderkey", "o_totalprice": "$.o_totalprice", "o_orderstatus": "$.o_orderstatus"}, orders=[["$.o_orderstatus", False], ["$.o_totalprice", True]], limit=25, output="&.m.x::o_orderkey use I")
job("cursor_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 20 OFFSET 10", "customer", {"c_custkey": "$.c_custkey", "c_name": "$.c_name"}, querys={"c_custkey": {">": 40}}, orders=[["$.c_custkey", False]], offset=10, limit=20)


@query("cursor_ties", "SELECT n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS nation, n_name FROM nation")
def cursor_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of seven nations behind a cursor that ties within each region, until one is empty."""
    databases = [{"name": "t", "driver": "parquet", "path": sf_dir}, {"name": "f", "driver": "parquet", "path": shared_folder(spark)}]
    schema = {"region": "$.n_regionkey", "nation": "$.n_nationkey", "n_name": "$.n_name"}
    config = {"databases": databases, "input": "&.t.nation", "output": "&.f.pages::nation use I", "schema": schema, "cursor": "region", "states": ["&.f.state"]}
    seen, before = -1, -2
    while seen != before:
        page = Job.from_config(spark, config, {"@limit": 7, "@recovery": True})
        page.run()
        before, seen = seen, page.catalog.read("f.pages").count()
    return page.catalog.read("f.pages")


@query("sqlite_filtered", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey > 40 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def sqlite_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source filters reach the statement that SQLite runs."""
    catalog = Catalog(spark, [{"name": "q", "driver": "sqlite", "path": f"{local_folder(spark)}/customers.db", "rows": 500}])
    write(catalog, "q.customer", spark.read.parquet(f"{sf_dir}/customer.parquet"), "insert", [], [], None)
    config = {"input": "&.q.customer", "schema": {n: f"$.{n}" for n in ("c_custkey", "c_name", "c_acctbal")}, "querys": {"c_custkey": {">": 40}, "c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}}}
    return Job.from_config(spark, config, catalog=catalog).plan()


@query("union_tasks", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.plans.job import run_all

    catalog = Catalog(spark)
    base = {"databases": [{"name": "t", "driver": "parquet", "path": sf_dir}]}
    jobs = [Job.from_config(spark, base | {"input": f"&.t.{t}", "output": "&.m.names use I", "schema": {"name": f"$.{c}"}}, catalog=catalog) for t, c in (("nation", "n_name"), ("region", "r_name"))]
    run_all(jobs)
    return catalog.read("m.names")


# --- casts and functions ---------------------------------------------------------------------------------

job("cast_int", "SELECT event_id, coalesce(try_cast(event_type AS BIGINT), 0)::BIGINT AS bad, CAST(trunc(value) AS BIGINT) AS whole, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS back FROM events", "events", {"event_id": "$.event_id", "bad": "$.event_type|int", "whole": "$.value|int", "back": ["#make", {"s": "$.event_id|str"}, ":$.s|int"]})
job("cast_float", "SELECT event_id, 0.0::DOUBLE AS bad, CAST(event_id AS DOUBLE) AS x FROM events", "events", {"event_id": "$.event_id", "bad": "$.event_type|float", "x": "$.event_id|float"})
job("cast_str_fmt", "SELECT event_id, printf('%05d', event_id) AS padded, strftime(ts, '%Y/%m/%d %H:%M') AS t, printf('%f', value) AS v FROM events", "events", {"event_id": "$.event_id", "padded": "$.event_id|str %05d", "t": "$.ts|str %Y/%m/%d %H:%M", "v": "$.value|str"})
job("cast_bool", "SELECT event_id, event_id <> 0 AS x, value <> 0 AS y, event_type <> '' AS z FROM events", "events", {"event_id": "$.event_id", "x": "$.event_id|bool", "y": "$.value|bool", "z": "$.event_type|bool"})
job("cast_datetime", "SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS t, CAST(ts AS DATE) AS d FROM events", "events", {"event_id": "$.event_id", "t": ["#make", {"s": "$.ts|str"}, ":$.s|datetime"], "d": "$.ts|date"})
_t = QUERIES["cast_datetime"]
QUERIES["cast_datetime"] = lambda spark, sf_dir: _t(spark, sf_dir).withColumn("t", F.col("t").cast("timestamp_ntz"))
job("cast_date_trunc", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('day', ts)::TIMESTAMP AS d FROM events", "events", {"event_id": "$.event_id", "h": "$.ts|datetime %Y-%m-%d %H:00:00", "d": "$.ts|datetime %Y-%m-%d"})


def _functions(name: str, table: str, key: str, fields: dict[str, tuple]) -> None:
    """A query of one column for each function: its call and its SQL."""
    job(name, f"SELECT {key}, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in fields.items()) + f" FROM {table}", table, {key: f"$.{key}"} | {n: x for n, (x, _) in fields.items()})


_functions("str_case", "part", "p_partkey", {"lo": (["@string::lower", "$.p_brand"], "lower(p_brand)"), "up": (["@string::upper", "$.p_name"], "upper(p_name)"), "cap": (["@string::capitalize", "$.p_brand"], "upper(p_brand[1]) || lower(p_brand[2:])")})
_functions("str_trim_pad", "part", "p_partkey", {"l": (["@string::ljust", "$.p_brand", 12, "*"], "rpad(p_brand, 12, '*')"), "r": (["@string::rjust", "$.p_brand", 12, "*"], "lpad(p_brand, 12, '*')"), "z": (["@string::zfill", "$.p_partkey|str", 8], "lpad(p_partkey::VARCHAR, 8, '0')"), "s": (["@string::strip", ["@add", "  ", "$.p_brand", " "]], "p_brand")})
_functions("str_search", "part", "p_partkey", {"f": (["@string::find", "$.p_name", "a"], "CAST(instr(p_name, 'a') - 1 AS BIGINT)"), "n": (["@string::count", "$.p_name", "e"], "CAST(length(p_name) - length(replace(p_name, 'e', '')) AS BIGINT)"), "b": (["@string::startswith", "$.p_brand", "Brand#1"], "starts_with(p_brand, 'Brand#1')"), "c": (["@string::contains", "$.p_type", "BRASS"], "contains(p_type, 'BRASS')"), "rf": (["@string::rfind", "$.p_name", "a"], "CAST(CASE WHEN contains(p_name, 'a') THEN length(p_name) - instr(reverse(p_name), 'a') ELSE -1 END AS BIGINT)")})
_functions("str_edit", "part", "p_partkey", {"r": (["@string::replace", "$.p_brand", "Brand", "B"], "replace(p_brand, 'Brand', 'B')"), "p": (["@string::removeprefix", "$.p_brand", "Brand#"], "CASE WHEN starts_with(p_brand, 'Brand#') THEN p_brand[7:] ELSE p_brand END"), "t": (["@string::translate", "$.p_brand", "abc", "xyz"], "translate(p_brand, 'abc', 'xyz')"), "n": (["@neg", "$.p_brand"], "reverse(p_brand)")})
_functions("str_split_join", "part", "p_partkey", {"first": (["@split", "$.p_name", " ", ":$.:0"], "string_split(p_name, ' ')[1]"), "joined": (["@join", ["@split", "$.p_name", " "], "-"], "replace(p_name, ' ', '-')"), "n": (["@array::count", ["@split", "$.p_name", " "], "x"], "CAST(len(list_filter(string_split(p_name, ' '), lambda x: x = 'x')) AS BIGINT)")})
_functions("str_tests", "part", "p_partkey", {"alpha": (["@string::isalpha", "$.p_brand"], "regexp_full_match(p_brand, '[A-Za-z]+')"), "digit": (["@string::isdigit", "$.p_partkey|str"], "regexp_full_match(p_partkey::VARCHAR, '[0-9]+')"), "upper": (["@string::isupper", "$.p_type"], "upper(p_type) = p_type AND lower(p_type) <> p_type")})
_functions("substring_slice", "part", "p_partkey", {"a": (["@substring", "$.p_name", 1, 4], "p_name[2:4]"), "b": (["@substring", "$.p_name", -3, 100], "right(p_name, 3)"), "c": (["@substring", "$.p_brand", 0, 6, 2], "p_brand[1] || p_brand[3] || p_brand[5]")})
_functions("dt_parts", "events", "event_id", {"y": ("$.ts.year", "year(ts)"), "h": ("$.ts.hour", "hour(ts)"), "w": (["@datetime::weekday", "$.ts"], "(isodow(ts) - 1)"), "d": (["@datetime::isoweekday", "$.ts"], "isodow(ts)")})
_functions("dt_format", "events", "event_id", {"i": (["@datetime::isoformat", "$.ts"], "strftime(ts, '%Y-%m-%dT%H:%M:%S')"), "f": (["@datetime::strftime", "$.ts", "%d.%m.%Y"], "strftime(ts, '%d.%m.%Y')")})
_functions("dt_at", "events", "event_id", {"a": (["@datetime::at", "$.ts", 6, 30, 0], "date_trunc('day', ts)::TIMESTAMP + INTERVAL '6 hours 30 minutes'"), "s": (["@datetime::startofday", "$.ts"], "date_trunc('day', ts)::TIMESTAMP")})
_functions("time_window_hour", "events", "event_id", {"w": (["@time_window", "6H", "$.ts"], "date_trunc('day', ts)::TIMESTAMP + to_hours(CAST(hour(ts) // 6 * 6 AS INTEGER))")})
_functions("time_window_day", "events", "event_id", {"w": (["@time_window", "7d", "$.ts"], "date_trunc('month', ts)::TIMESTAMP + to_days(CAST(greatest(day(ts) // 7 * 7, 1) - 1 AS INTEGER))")})
_functions("time_window_week", "events", "event_id", {"w": (["@time_window", "1w", "$.ts"], "date_trunc('week', ts)::TIMESTAMP")})
_MONDAY = "date_trunc('week', ts)"
_functions(
    "time_window_starts",
    "events",
    "event_id",
    {
        "tuesday": (["@time_window", "1w", "$.ts", 0, 2], f"{_MONDAY}::TIMESTAMP + INTERVAL 1 DAY"),
        "before": (["@time_window", "1w", "$.ts", 2], f"{_MONDAY}::TIMESTAMP - INTERVAL 14 DAY"),
        "later": (["@time_window", "6H", "$.ts", 2], "date_trunc('day', ts)::TIMESTAMP + to_hours(CAST(hour(ts) // 6 * 6 + 12 AS INTEGER))"),
        "third": (["@time_window", "3w", "$.ts"], f"{_MONDAY}::TIMESTAMP - to_days(CAST(7 * (CAST(strftime(ts, '%W') AS INTEGER) % 3) AS INTEGER))"),
    },
)
SQL["dt_parts"] = "SELECT event_id, " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in (("y", "year(ts)"), ("h", "hour(ts)"), ("w", "isodow(ts) - 1"), ("d", "isodow(ts)"))) + " FROM events"


def _rounded(name: str, table: str, key: str, fields: dict[str, tuple], digits: int = 6) -> None:
    _functions(name, table, key, {n: (x, f"round({sql}, {digits})") for n, (x, sql) in fields.items()})
    inner = QUERIES[name]
    QUERIES[name] = lambda spark, sf_dir: inner(spark, sf_dir).withColumns({n: F.round(n, digits) for n in fields})


_rounded("math_basic", "events", "event_id", {"s": (["@math::sqrt", "$.value"], "sqrt(abs(value))"), "l": (["@math::log", ["@add", "$.value", 1.5]], "ln(value + 1.5)"), "p": (["@math::pow", "$.value", 2], "pow(value, 2)"), "h": (["@math::hypot", "$.value", 3], "sqrt(value * value + 9)")}, 4)
_rounded("math_trig", "events", "event_id", {"s": (["@math::sin", "$.value"], "sin(value)"), "c": (["@math::cos", "$.value"], "cos(value)"), "a": (["@math::atan", "$.value"], "atan(value)"), "r": (["@math::radians", "$.value"], "radians(value)")})
_functions("math_whole", "events", "event_id", {"f": (["@math::floor", "$.value"], "CAST(floor(value) AS BIGINT)"), "c": (["@math::ceil", "$.value"], "CAST(ceil(value) AS BIGINT)"), "g": (["@math::gcd", "$.event_id", 12], "CAST(gcd(event_id, 12) AS BIGINT)"), "bad": (["@math::sqrt", -1.0], "0.0::DOUBLE")})
_R5 = ["@range", ["@add", ["@mod", "$.p_size", 5], 1]]
_SQL5 = "range(0, p_size % 5 + 1)"
_functions("arr_access", "part", "p_partkey", {"f": (["@array::first", _R5], f"CAST({_SQL5}[1] AS BIGINT)"), "l": (["@array::last", _R5], f"CAST({_SQL5}[-1] AS BIGINT)"), "i": (["@array::index", _R5, 1], f"CAST(coalesce(list_position({_SQL5}, 1), 0) - 1 AS BIGINT)")})
_functions("arr_agg", "part", "p_partkey", {"s": (["@array::sum", _R5], f"CAST(list_sum({_SQL5}) AS BIGINT)"), "hi": (["@array::max", _R5], f"CAST(list_max({_SQL5}) AS BIGINT)"), "lo": (["@array::min", _R5], f"CAST(list_min({_SQL5}) AS BIGINT)"), "m": (["@array::avg", _R5], f"list_avg({_SQL5})")})
_functions("arr_edit", "part", "p_partkey", {"a": (["@join", ["@array::append", _R5, 9], ","], f"array_to_string(list_append({_SQL5}, 9), ',')"), "r": (["@join", ["@array::reverse", _R5], ","], f"array_to_string(list_reverse({_SQL5}), ',')"), "x": (["@join", ["@array::remove", _R5, 1], ","], f"array_to_string(list_filter({_SQL5}, lambda i: i <> 1), ',')")})
_functions("arr_filter_index_sort", "part", "p_partkey", {"g": (["@join", ["@array::gt", _R5, 1], ","], f"array_to_string(list_filter({_SQL5}, lambda i: i > 1), ',')"), "d": (["@join", ["@sort", _R5, True], ","], f"array_to_string(list_reverse_sort({_SQL5}), ',')"), "f": (["@len", ["@split", "$.p_name", " "], [":@join", "$.*", ","]], "array_to_string(list_transform(string_split(p_name, ' '), lambda w: length(w)), ',')")})
_functions("range_list", "part", "p_partkey", {"r": (["@join", ["@range", 1, "$.p_size", 7], ","], "array_to_string(range(1, p_size, 7), ',')"), "s": (["@sum", ["@range", "$.p_size"]], "CAST(p_size * (p_size - 1) // 2 AS BIGINT)")})
_MAP = ["#make", {"a": "$.p_partkey", "b": "$.p_size"}]
_functions("map_ops", "part", "p_partkey", {"k": (["@join", ["@map::keys", _MAP], ","], "'a,b'"), "v": (["@sum", ["@map::values", _MAP]], "CAST(p_partkey + p_size AS BIGINT)"), "g": (["@map::get", _MAP, "b"], "CAST(p_size AS BIGINT)"), "d": (["@map::get", _MAP, "zz", -1], "CAST(-1 AS BIGINT)")})
_functions("json_decode_get", "events", "event_id", {"k": (["@json::decode", "$.props", "struct<k:bigint>", ":$.k"], "CAST(json_extract(props, '$.k') AS BIGINT)")})
_functions("json_encode", "events", "event_id", {"j": (["@json::encode", ["#make", {"id": "$.event_id", "t": "$.event_type"}]], "'{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}'")})
_functions("hash_md5_sha", "part", "p_partkey", {"m": (["@hash::md5", "$.p_name"], "md5(p_name)"), "s": (["@hash::sha256", "$.p_name", "$.p_brand"], "sha256(p_name || p_brand)")})
_functions("re_extract", "part", "p_partkey", {"m": (["@re::search", "#(\\d+)", "$.p_brand", 1], "nullif(regexp_extract(p_brand, '#(\\d+)', 1), '')"), "f": (["@re::fullmatch", "Brand#1.", "$.p_brand"], "CASE WHEN regexp_full_match(p_brand, 'Brand#1.') THEN p_brand END")})
_SEEN = ["@re::search", "([a-z])(d#)", "$.p_brand"]
_functions(
    "re_match_methods",
    "part",
    "p_partkey",
    {
        "groups": (["@join", ["@re::groups", _SEEN], "/"], "regexp_extract(p_brand, '([a-z])(d#)', 1) || '/' || regexp_extract(p_brand, '([a-z])(d#)', 2)"),
        "start": (["@re::start", _SEEN], "CAST(instr(p_brand, 'd#') - 2 AS BIGINT)"),
        "ends": (["@re::end", _SEEN], "CAST(instr(p_brand, 'd#') + 1 AS BIGINT)"),
        "second": (["@re::group", _SEEN, 2], "regexp_extract(p_brand, '([a-z])(d#)', 2)"),
    },
)
_functions(
    "math_counts",
    "part",
    "p_partkey",
    {
        "ways": (["@math::comb", ["@mod", "$.p_size", 20], 3], "CAST(CASE WHEN p_size % 20 < 3 THEN 0 ELSE (p_size % 20) * (p_size % 20 - 1) * (p_size % 20 - 2) // 6 END AS BIGINT)"),
        "orders": (["@math::perm", ["@mod", "$.p_size", 20], 2], "CAST((p_size % 20) * (p_size % 20 - 1) AS BIGINT)"),
        "shared": (["@math::lcm", "$.p_size", 12], "CAST(lcm(p_size, 12) AS BIGINT)"),
        "root": (["@math::isqrt", "$.p_partkey"], "CAST(floor(sqrt(p_partkey)) AS BIGINT)"),
        "named": (["@max", ["@make", "$.p_size", 10], ["#const", {"10": "ten", "11": "eleven"}]], "CASE WHEN p_size <= 10 THEN 'ten' WHEN p_size = 11 THEN 'eleven' END"),
    },
)
_functions("re_replace", "part", "p_partkey", {"r": (["@re::sub", "[aeiou]", "_", "$.p_name"], "regexp_replace(p_name, '[aeiou]', '_', 'g')")})
_functions("re_findall", "part", "p_partkey", {"f": (["@join", ["@re::findall", "[a-z]+", "$.p_name"], "+"], "array_to_string(regexp_extract_all(p_name, '[a-z]+'), '+')")})
_functions("type_tests", "part", "p_partkey", {"t": (["@type", "$.p_name"], "'str'"), "i": (["@is_int", "$.p_partkey"], "1::BIGINT"), "n": (["@is_null", "$.p_name"], "0::BIGINT"), "e": (["@empty", "$.p_partkey"], "CAST(CASE WHEN p_partkey <> 0 THEN 1 ELSE 0 END AS BIGINT)")})
_functions("contain_in", "part", "p_partkey", {"i": (["@in", "$.p_size", _R5], "CAST(CASE WHEN p_size <= p_size % 5 THEN 1 ELSE 0 END AS BIGINT)"), "c": (["@contain", "$.p_name", "a"], "CAST(CASE WHEN contains(p_name, 'a') THEN 1 ELSE 0 END AS BIGINT)")})
_functions("greatest_least", "part", "p_partkey", {"hi": (["@max", "$.p_size", 25], "CAST(greatest(p_size, 25) AS BIGINT)"), "lo": (["@min", "$.p_size", "$.p_retailprice"], "least(p_size, p_retailprice)")})
_functions("textline_split", "part", "p_partkey", {"s": (["@textline::split", "$.p_name", " ", ":$.:1"], "string_split(p_name, ' ')[2]")})

# --- sources, variables, sinks, streams ----------------------------------------------------------------


def _view(spark: SparkSession, sf_dir: str, view: dict, **more) -> DataFrame:
    config = {"databases": [{"name": "v", "driver": "parquet", "path": sf_dir, "virtual_views": [view]}], "input": f"&.v.{more.pop('table', view.get('name'))}", "schema": "$.*"} | more
    return Job.from_config(spark, config).plan()


@query("virtual_view", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def virtual_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, {"name": "counts", "tables": ["orders"], "query": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"})


@query("virtual_view_args", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 60000 GROUP BY 1")
def virtual_view_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = {"name_match": "orders_by_.*", "tables": ["orders"], "query": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= ? AND o_totalprice < ? GROUP BY 1", "args": [["o_totalprice", ">=", 0], ["o_totalprice", "<", 60000]]}
    return _view(spark, sf_dir, view, table="orders_by_customer", querys={"o_totalprice": {">=": 1000}})


@query("row_generator", "SELECT r_name AS x FROM range(1000), region WHERE r_regionkey = 1")
def row_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir, {"input": "&.t.--1000", "schema": {"x": [["#const", 1], "&.t.region::r_regionkey", ":$.r_name"]}, "options": _ONE})


job("assign_counter", "SELECT c_custkey, 100 + row_number() OVER (ORDER BY c_custkey) AS n FROM customer", "customer", {"c_custkey": "$.c_custkey", "n": ["#assign", "n", ["@add", "$.n", 1]]}, variables={"n": 100}, options={"sequence": "c_custkey"})
job("assign_running", "SELECT c_custkey, CAST(sum(c_nationkey) OVER (ORDER BY c_custkey) AS BIGINT) AS s FROM customer", "customer", {"c_custkey": "$.c_custkey", "s": ["#assign", "s", ["@add", "$.s", "$$.c_nationkey"]]}, variables={"s": 0}, options={"sequence": "c_custkey"})

_BY_ID = {"options": {"sequence": "c_custkey"}}
_RUNNING = "OVER (ORDER BY c_custkey)"
job("assign_product", f"SELECT c_custkey, CAST(CASE WHEN sum(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END) {_RUNNING} % 2 = 0 THEN 5 ELSE -5 END AS BIGINT) AS p FROM customer", "customer", {"c_custkey": "$.c_custkey", "p": ["#assign", "p", ["@mul", "$.p", ["#if", ["@eq", ["@mod", "$$.c_nationkey", 3], 0], -1, 1]]]}, variables={"p": 5}, **_BY_ID)
job("assign_extremes", f"SELECT c_custkey, max(c_acctbal) {_RUNNING} AS hi, min(CASE WHEN c_nationkey > 12 THEN c_acctbal END) {_RUNNING} AS lo FROM customer", "customer", {"c_custkey": "$.c_custkey", "hi": ["#assign", "hi", ["@max", "$.hi", "$$.c_acctbal"]], "lo": ["#assign", "lo", ["#if", ["@gt", "$$.c_nationkey", 12], ["@min", "$.lo", "$$.c_acctbal"], "$.lo"]]}, variables={"hi": None, "lo": None}, **_BY_ID)
job(
    "assign_steps",
    """SELECT c_custkey, CAST(count(*) OVER (PARTITION BY run ORDER BY c_custkey) - 1 + CASE WHEN run = 0 THEN 101 ELSE 0 END AS BIGINT) AS since, last_value(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END IGNORE NULLS) OVER (ORDER BY c_custkey) AS last
    FROM (SELECT *, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) OVER (ORDER BY c_custkey) AS run FROM customer)""",
    "customer",
    {"c_custkey": "$.c_custkey", "since": ["#assign", "since", ["#if", ["@eq", "$$.c_mktsegment", "BUILDING"], 0, ["@add", "$.since", 1]]], "last": ["#assign", "last", ["#if", ["@eq", "$$.c_mktsegment", "BUILDING"], "$$.c_custkey", "$.last"]]},
    variables={"since": 100, "last": None},
    **_BY_ID,
)
job(
    "assign_any_step",
    "SELECT c_custkey, CAST(list_reduce(list_prepend(1::BIGINT, list(c_nationkey::BIGINT) OVER (ORDER BY c_custkey)), lambda acc, x: (acc * 3 + x) % 10007) AS BIGINT) AS h FROM customer",
    "customer",
    {"c_custkey": "$.c_custkey", "h": ["#assign", "h", ["@mod", ["@add", ["@mul", "$.h", 3], "$$.c_nationkey"], 10007]]},
    variables={"h": 1},
    **_BY_ID,
)

_OLD = "(SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0)"
_SINKS = {
    "update": f"SELECT o.id, coalesce(n.price, o.price) AS price, coalesce(n.s, o.s) AS s FROM {_OLD} o LEFT JOIN {_NEW} n ON o.id = n.id",
    "upsert": f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, coalesce(n.s, o.s) AS s FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id",
    "sync": f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, coalesce(n.s, o.s) AS s FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id WHERE NOT (n.id IS NULL AND o.s = 'F')",
    "replace": f"SELECT * FROM {_OLD} WHERE s <> 'F' UNION ALL SELECT * FROM {_NEW}",
    "append": f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW}",
}


def _sink(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("s"))
        old = orders.where("id % 3 <> 0")
        new = orders.where("id % 5 <> 0").withColumn("price", F.when(F.col("id") % 2 == 0, F.col("price") + 1).otherwise(F.col("price")))
        return apply_mode("insert" if mode == "append" else mode, old, new, ["id"], scope=lambda df: df["s"] == "F").drop("_change")

    return run


def _sqlite_sink(mode: str) -> Query:
    """The same change on a table of a SQLite file, read back from it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("s"))
        catalog = Catalog(spark, [{"name": "q", "driver": "sqlite", "path": f"{local_folder(spark)}/orders.db"}])
        new = orders.where("id % 5 <> 0").withColumn("price", F.when(F.col("id") % 2 == 0, F.col("price") + 1).otherwise(F.col("price")))
        write(catalog, "q.orders", orders.where("id % 3 <> 0"), "insert", [], [], None)
        write(catalog, "q.orders", new, mode, ["id"], [], lambda df: df["s"] == "F")
        return catalog.read("q.orders")

    return run


for _m, _sql in _SINKS.items():
    QUERIES[f"sqlite_{_m}"], SQL[f"sqlite_{_m}"] = _sqlite_sink("insert" if _m == "append" else _m), _sql
for _m, _sql in _SINKS.items():
    QUERIES[f"sink_{_m}"], SQL[f"sink_{_m}"] = _sink(_m), _sql


def _streamed(spark: SparkSession, sf_dir: str):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query("stream_batch_agg", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1")
def stream_batch_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in micro-batches, each through the job; the partial sums meet in the sink's table."""
    from weftline.streaming.runner import run_stream

    catalog = Catalog(spark)
    schema = {"event_type": "$.event_type", "n": ["#aggregate", "$.event_type", ["@add", "$.n", 1]], "s": ["#aggregate", "$.event_type", ["@add", "$.s", "$$.value"]]}
    work = shared_folder(spark)
    catalog.add({"name": "f", "driver": "parquet", "path": work})
    batch = Job.from_config(spark, {"input": "&.f.unused", "output": "&.f.parts use I", "schema": schema}, catalog=catalog)
    run_stream(batch, _streamed(spark, sf_dir), f"{work}/checkpoint").awaitTermination()
    return catalog.read("f.parts").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("s"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.streaming import tumbling

    work = shared_folder(spark)
    out = tumbling(_streamed(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], {"n": F.count(F.lit(1))}, late="400 days")
    # only windows that a batch has changed come, and replace their rows; the watermark lets old windows go
    catalog = Catalog(spark, [{"name": "f", "driver": "parquet", "path": work}])
    put = lambda batch, _: write(catalog, "f.windows", batch, "upsert", ["window_start", "event_type"], [], None)
    out.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return catalog.read("f.windows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("udf_import", "SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS x FROM part")
def udf_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    from weftline.functions import register_udf

    def twice_and_one(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    register_udf("demo::twice_and_one", twice_and_one, "long")
    return plan(spark, sf_dir, {"input": "&.t.part", "schema": {"p_partkey": "$.p_partkey", "x": ["@demo::twice_and_one", "$.p_size"]}})


@query("udtf_loader", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 10 AND o_orderstatus = 'F'")
def udtf_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function as the input: it is told the columns and filters, and reads no others."""
    catalog = Catalog(spark)

    def finished(s: SparkSession, tests: dict, request: dict) -> DataFrame:
        return s.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(*request["fields"])

    catalog.register_function("finished", finished)
    return Job.from_config(spark, {"input": "&.=@finished::o_orderkey", "schema": {"o_orderkey": "$.o_orderkey", "o_totalprice": "$.o_totalprice"}, "querys": {"o_orderkey": {">=": 10}}}, catalog=catalog).plan()


@query("lookup_function", "SELECT o_orderkey, o_custkey * o_custkey % 97 AS code, CASE WHEN o_custkey % 2 = 0 THEN 'even' END AS kind FROM orders")
def lookup_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of keys as the looked-up table: asked for each customer once."""
    catalog = Catalog(spark, [{"name": "t", "driver": "parquet", "path": sf_dir}])
    catalog.register_lookup("code", lambda keys: [{"k": r["k"], "code": r["k"] * r["k"] % 97, "kind": "even" if r["k"] % 2 == 0 else None} for r in keys], "k long, code long, kind string", batch=500)
    found = ["$.o_custkey", "&.=@code::k"]
    return Job.from_config(spark, {"input": "&.t.orders", "schema": {"o_orderkey": "$.o_orderkey", "code": [*found, ":$.code"], "kind": [*found, ":$.kind"]}, "options": {"unique": ["=@code"]}}, catalog=catalog).plan()


job("load_rows", "SELECT n_nationkey::BIGINT AS n_nationkey, r_name || '/' || n_name AS pair FROM nation, region", "nation", {"n_nationkey": "$.n_nationkey", "pair": ["&&.t.region", [":@add", "$.r_name", "/", "$$.n_name"]]})


@query("lookup_view_args", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 60000 GROUP BY 1) ON c_custkey = o_custkey")
def lookup_view_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A looked-up view whose arguments take the lookup's filters."""
    view = {"name": "counts", "tables": ["orders"], "query": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= ? AND o_totalprice < ? GROUP BY 1", "args": [["o_totalprice", ">=", 0], ["o_totalprice", "<", 60000]]}
    databases = [{"name": "t", "driver": "parquet", "path": sf_dir, "virtual_views": [view]}]
    found = ["$.c_custkey", ["&.t.counts::o_custkey", {"o_totalprice": {">=": 1000}}], [":@sum", "$.n"]]
    return Job.from_config(spark, {"databases": databases, "input": "&.t.customer", "schema": {"c_custkey": "$.c_custkey", "n": found}}).plan()


_REVENUE = ["@mul", "$$.l_extendedprice", ["@sub", 1, "$$.l_discount"]]


@query("tpch_q1_like", "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 5) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def tpch_q1_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"flag": "$.l_returnflag", "status": "$.l_linestatus", "qty": _agg(["@add", "$.qty", "$$.l_quantity"]), "revenue": _agg(["@add", "$.revenue", _REVENUE]), "n": _agg(["@add", "$.n", 1])}
    out = plan(spark, sf_dir, {"input": "&.t.lineitem", "schema": schema, "querys": {"l_shipdate": {"<=": "1998-09-02"}}})
    return out.withColumns({"qty": F.round("qty", 2), "revenue": F.round("revenue", 5)})


@query("tpch_q3_like", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 5) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def tpch_q3_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = ["$.l_orderkey", "&.t.orders::o_orderkey", [":$.o_custkey", "&.t.customer::c_custkey", ":$.c_mktsegment"]]
    schema = {"l_orderkey": "$.l_orderkey", "revenue": ["#aggregate", "$.l_orderkey", ["@add", "$.revenue", _REVENUE]]}
    out = plan(spark, sf_dir, {"input": "&.t.lineitem", "schema": schema, "predicate": ["@eq", segment, "BUILDING"], "options": _ONE})
    return out.withColumn("revenue", F.round("revenue", 5))


@query("tpch_q5_like", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 5) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def tpch_q5_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = ["$.l_suppkey", "&.t.supplier::s_suppkey", [":$.s_nationkey", "&.t.nation::n_nationkey", ":$.n_name"]]
    schema = {"n_name": name, "revenue": ["#aggregate", name, ["@add", "$.revenue", _REVENUE]]}
    out = plan(spark, sf_dir, {"input": "&.t.lineitem", "schema": schema, "options": _ONE})
    return out.withColumn("revenue", F.round("revenue", 5))


@query("tpch_q10_like", "SELECT o_custkey, round(sum(l_extendedprice * (1 - l_discount)), 5) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def tpch_q10_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = ["$.l_orderkey", "&.t.orders::o_orderkey", ":$.o_custkey"]
    schema = {"o_custkey": customer, "revenue": ["#aggregate", customer, ["@add", "$.revenue", _REVENUE]]}
    out = plan(spark, sf_dir, {"input": "&.t.lineitem", "schema": schema, "querys": {"l_returnflag": "R"}, "options": _ONE, "intercept": ["@not", ["@is_null", "$.o_custkey"]]})
    return out.withColumn("revenue", F.round("revenue", 5))


job("generated_ids", None, "region", {"r_regionkey": "$.r_regionkey", "u": "@uuid", "o": "@objectid", "s": "@snowflakeid", "r": ["@random::string", 6], "now": ["@now", "-3d"]})


@query("flagship", None)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items to orders to customers to nations: lines, sales and the last shipment of each nation."""
    nation = ["$.l_orderkey", "&.t.orders::o_orderkey", [":$.o_custkey", "&.t.customer::c_custkey", [":$.c_nationkey", "&.t.nation::n_nationkey", ":$.n_name"]]]
    schema = {"nation": nation, "n_lines": ["#aggregate", nation, ["@add", "$.n_lines", 1]], "sales": ["#aggregate", nation, ["@add", "$.sales", "$$.l_extendedprice"]], "last_shipped": ["#aggregate", nation, ["@max", "$.last_shipped", "$$.l_shipdate"]]}
    out = plan(spark, sf_dir, {"input": "&.t.lineitem", "schema": schema, "options": _ONE, "intercept": ["@gt", "$.n_lines", 0], "orders": [["$.nation", False]]})
    return out.withColumn("sales", F.round("sales", 2))


SQL["flagship"] = "SELECT n_name AS nation, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS sales, max(l_shipdate) AS last_shipped FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


# --- wrong answers of before, told by SQL ---------------------------------------------------------

job("re_groups", "SELECT o_orderkey, regexp_extract(o_orderpriority, '(\\d)-(\\w)', 1) || '|' || regexp_extract(o_orderpriority, '(\\d)-(\\w)', 2) AS parts FROM orders", "orders", {"o_orderkey": "$.o_orderkey", "parts": ["@join", ["@re::findall", r"(\d)-(\w)", "$.o_orderpriority", ":$.:0"], "|"]})
job("str_splits", "SELECT p_partkey, split_part(p_type, ' ', 1) AS head, nullif(substr(p_type, length(split_part(p_type, ' ', 1)) + 2), '') AS rest FROM part", "part", {"p_partkey": "$.p_partkey", "head": ["@string::split", "$.p_type", " ", 1, ":$.:0"], "rest": ["@string::split", "$.p_type", " ", 1, ":$.:1"]})
job("loop_marks", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN '0,1,7,3' ELSE '0,1,2,3' END AS marks FROM nation", "nation", {"n_nationkey": "$.n_nationkey", "marks": ["@join", ["#foreach", ["@range", 4], ["#if", ["@and", ["@eq", "$._value_", 2], ["@eq", "$$.n_regionkey", 2]], ["#continue", 7], "$._value_"]], ","]})
_win("win_index", f"(row_number() {_OVER} - 1) * 100 + event_id", ["@add", ["@mul", "$.context.current_index", 100], "$.value"], value="$.event_id")


@query("literal_rows", "SELECT v.*, n_name FROM (VALUES (1::BIGINT, 'x'), (5::BIGINT, NULL)) v(a, b) JOIN nation ON n_nationkey = a")
def literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir, {"input": [{"a": 1, "b": "x"}, {"a": 5}, {"a": -3}], "querys": {"a": {">": 0}}, "schema": {"a": "$.a", "b": "$.b", "n_name": ["$.a", "&.t.nation::n_nationkey", ":$.n_name"]}, "options": _ONE})


@query(
    "pivot_h4v_repeats",
    """WITH RECURSIVE t AS (SELECT o_custkey AS id, o_orderkey AS v, o_orderstatus AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus IN ('F', 'O')),
    w AS (SELECT id, i, v, k, 1 AS n, [k] AS seen FROM t WHERE i = 1
      UNION ALL SELECT t.id, t.i, t.v, t.k, w.n + CASE WHEN list_contains(w.seen, t.k) THEN 1 ELSE 0 END, CASE WHEN list_contains(w.seen, t.k) THEN [t.k] ELSE list_append(w.seen, t.k) END FROM w JOIN t ON t.id = w.id AND t.i = w.i + 1)
    SELECT id, max(CASE WHEN k = 'F' THEN v END) AS f, max(CASE WHEN k = 'O' THEN v END) AS o FROM w GROUP BY id, n""",
)
def pivot_h4v_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.shape import h4v

    long = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus IN ('F', 'O')").select(F.col("o_custkey").alias("id"), "o_orderstatus", "o_orderkey")
    wide = h4v(long.withColumn("at", F.col("id") * 10_000_000_000 + F.col("o_orderkey")), "o_orderstatus", "o_orderkey", "id", columns=["F", "O"], order="at")
    return wide.select("id", F.col("F").alias("f"), F.col("O").alias("o"))


@query("asof_ties", "SELECT a.event_id, b.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN LATERAL (SELECT event_id FROM events e WHERE e.event_type = 'click' AND e.user_id = a.user_id AND date_trunc('day', e.ts) < date_trunc('day', a.ts) ORDER BY date_trunc('day', e.ts) DESC, e.event_id DESC LIMIT 1) b ON true")
def asof_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.date_trunc("day", "ts"))
    bought, clicked = events.where("event_type = 'purchase'"), events.where("event_type = 'click'")
    return asof_join(bought.select("event_id", "user_id", "day"), clicked, ["user_id"], "day", "day", ["event_id"], ties=["event_id"]).select("event_id", "asof_event_id")


# --- conversions, type tests and functions of lists ------------------------------------------------

_P = ["@eq", "$.o_orderstatus", "P"]
_NOT_P = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {} END"
job(
    "convert_numbers",
    f"""SELECT o_orderkey, coalesce({_NOT_P.format("o_orderkey")}, 0) AS i, CAST(coalesce({_NOT_P.format("o_orderkey")}, 0) AS DOUBLE) AS f,
    coalesce({_NOT_P.format("o_orderkey <> 0")}, false) AS b FROM orders""",
    "orders",
    {"o_orderkey": "$.o_orderkey", "i": ["@convert_int", ["#if", _P, None, "$.o_orderkey"]], "f": ["@convert_float", ["#if", _P, None, "$.o_orderkey"]], "b": ["@convert_bool", ["#if", _P, None, "$.o_orderkey"]]},
)
job(
    "convert_texts",
    f"""SELECT o_orderkey, coalesce({_NOT_P.format("o_orderpriority")}, '') AS s, coalesce({_NOT_P.format("o_orderpriority || '|x'")}, '') AS n,
    CASE WHEN o_orderstatus = 'P' THEN '00000000-0000-0000-0000-000000000000' ELSE '0123abcd-0000-4000-8000-0123456789ab' END AS u,
    CASE WHEN o_orderstatus = 'P' THEN '000000000000000000000000' ELSE '0123abcd0123abcd0123abcd' END AS o FROM orders""",
    "orders",
    {
        "o_orderkey": "$.o_orderkey",
        "s": ["@convert_string", ["#if", _P, None, "$.o_orderpriority"]],
        "n": ["@join", ["@convert_array", ["#if", _P, None, ["@make", "$.o_orderpriority", "x"]]], "|"],
        "u": ["@convert_uuid", ["#if", _P, None, "0123abcd-0000-4000-8000-0123456789ab"]],
        "o": ["@convert_objectid", ["#if", _P, None, "0123abcd0123abcd0123abcd"]],
    },
)
job(
    "convert_times",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS d, strftime(ts, '%H:%M:%S') AS t FROM events",
    "events",
    {"event_id": "$.event_id", "d": ["@convert_date", ["#if", ["@eq", "$.event_type", "error"], None, "$.ts"]], "t": ["@convert_time", "$.ts"]},
)
job(
    "is_kinds",
    f"""SELECT o_orderkey, {_NOT_P.format("1::BIGINT")} AS whole, 1::BIGINT AS real_, {_NOT_P.format("0::BIGINT")} AS text_, 1::BIGINT AS number_, 1::BIGINT AS time_, 1::BIGINT AS day_,
    CASE WHEN o_orderstatus = 'P' THEN 0::BIGINT ELSE 1::BIGINT END AS truth, 1::BIGINT AS list_, 0::BIGINT AS id_ FROM orders""",
    "orders",
    {
        "o_orderkey": "$.o_orderkey",
        "whole": ["@is_int", ["#if", _P, None, "$.o_orderkey"]],
        "real_": ["@is_float", "$.o_totalprice"],
        "text_": ["@is_string", ["#if", _P, None, "$.o_orderkey"]],
        "number_": ["@is_number", "$.o_totalprice"],
        "time_": ["@is_datetime", "$.o_orderdate"],
        "day_": ["@is_date", "$.o_orderdate"],
        "truth": ["@is_bool", ["#if", _P, None, ["#const", True]]],
        "list_": ["@is_array", ["@make", "$.o_orderkey"]],
        "id_": ["@is_uuid", "$.o_orderpriority"],
    },
)
job(
    "identity_same",
    "SELECT p_partkey, p_size::BIGINT AS x, CASE WHEN p_size = 7 THEN 1::BIGINT ELSE 0::BIGINT END AS seven, p_size || '/' || p_partkey AS pair FROM part",
    "part",
    {"p_partkey": "$.p_partkey", "x": ["@", "$.p_size"], "seven": ["@is", "$.p_size", 7], "pair": ["@join", ["@make", "$.p_size|str", "$.p_partkey|str"], "/"]},
)
job(
    "abs_index_filter",
    "SELECT p_partkey, abs(p_size - 25)::BIGINT AS far, CASE WHEN p_size = 10 THEN 30::BIGINT ELSE 2 * p_size::BIGINT END AS same, CASE WHEN p_size = 11 THEN 11::BIGINT END AS eleven FROM part",
    "part",
    {"p_partkey": "$.p_partkey", "far": ["@abs", ["@sub", "$.p_size", 25]], "same": ["@sum", ["@filter", ["@make", "$.p_size", 10, "$.p_size"], "$.p_size"]], "eleven": ["@index", ["@make", "$.p_size", 5], 11]},
)
job(
    "lambda_lists",
    "SELECT p_partkey, array_to_string(list_filter([p_size::BIGINT, 20, 30], lambda x: x > 15), ',') AS big, array_to_string(list_reverse_sort([p_size::BIGINT, 20, 30]), ',') AS down FROM part",
    "part",
    {
        "p_partkey": "$.p_partkey",
        "big": ["@join", ["@filter", ["@make", "$.p_size", 20, 30], ["#lambda", ["@gt", "$", 15]]], ","],
        "down": ["@join", ["@sort", ["@make", "$.p_size", 20, 30], ["#lambda", ["@sub", 0, "$"]]], ","],
    },
)
job("state_default", "SELECT r_regionkey::BIGINT AS r_regionkey, 7::BIGINT AS n FROM region", "region", {"r_regionkey": "$.r_regionkey", "n": ["#state", "$.rows", 7]})

# --- lookups and folds over what is expanded -------------------------------------------------------

job("lookup_right_cast", "SELECT n_nationkey::BIGINT AS n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", {"n_nationkey": "$.n_nationkey", "r_name": ["$.n_regionkey|str", "&.t.region::r_regionkey|int", ":$.r_name"]}, options=_ONE)
job(
    "lookup_over_rows",
    "SELECT r_regionkey::BIGINT AS r_regionkey, (SELECT coalesce(sum(s_suppkey), 0)::BIGINT FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n FROM region",
    "region",
    {"r_regionkey": "$.r_regionkey", "n": ["$.r_regionkey", "&.t.nation::n_regionkey", [":$.n_nationkey", "&.t.supplier::s_nationkey", [":@sum", "$.s_suppkey"]]]},
)
_HALF = ["#yield", ["@string::split", "$.o_orderpriority", "-"]]
job(
    "agg_over_yield",
    "SELECT part, count(*) AS n FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS part FROM orders) GROUP BY 1",
    "orders",
    {"part": _HALF, "n": ["#aggregate", _HALF, ["@add", "$.n", 1]]},
)


def _round_trip(spark: SparkSession, sf_dir: str, driver: str, **more) -> DataFrame:
    """Nations written by a job in one format and read by another job from it."""
    databases = [{"name": "t", "driver": "parquet", "path": sf_dir}, {"name": "f", "driver": driver, "path": shared_folder(spark)} | more]
    schema = {"n_nationkey": "$.n_nationkey", "n_name": "$.n_name"}
    Job.from_config(spark, {"databases": databases, "input": "&.t.nation", "output": "&.f.nation use I", "schema": schema}).run()
    return Job.from_config(spark, {"databases": databases, "input": "&.f.nation", "schema": {"n_nationkey": "$.n_nationkey|int", "n_name": "$.n_name"}}).plan()


_NATIONS = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"
query("csv_round_trip", _NATIONS)(lambda spark, sf_dir: _round_trip(spark, sf_dir, "csv"))
query("json_round_trip", _NATIONS)(lambda spark, sf_dir: _round_trip(spark, sf_dir, "json", lines=True))
query("textline_round_trip", _NATIONS)(lambda spark, sf_dir: _round_trip(spark, sf_dir, "textline", format="json"))
query("parquet_round_trip", _NATIONS)(lambda spark, sf_dir: _round_trip(spark, sf_dir, "parquet"))


@query("udaf_fold", "SELECT o_custkey, bit_xor(o_orderkey) AS x, count(*) AS n FROM orders GROUP BY 1")
def udaf_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold in Python beside one of Spark's own."""
    from weftline.functions import register_fold

    register_fold("demo::xor", lambda state, value: int(value) ^ (state or 0), "long")
    schema = {"o_custkey": "$.o_custkey", "x": ["#aggregate", "$.o_custkey", ["@demo::xor", "$.x", "$$.o_orderkey"]], "n": ["#aggregate", "$.o_custkey", ["@add", "$.n", 1]]}
    return plan(spark, sf_dir, {"input": "&.t.orders", "schema": schema})
