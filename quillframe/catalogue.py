"""The query catalogue: plans over the test tables, one or more per operator, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe import catalogue_verbs  # noqa: F401  (adds its queries to the registry)
from quillframe.frame import Frame
from quillframe.operators import groups, rows
from quillframe.plans import checks, differ, profile
from quillframe.plans.engine import Engine
from quillframe.registry import ORACLE_SQL, QUERIES
from quillframe.registry import code as _code
from quillframe.registry import folder as _folder
from quillframe.sources import sinks, trees
from quillframe.sources.readers import delimited, jsonl, parquet



def _tables(spark: SparkSession, sf_dir: str, names: dict[str, str] | list[str]) -> dict[str, Frame]:
    pairs = names.items() if isinstance(names, dict) else ((n, n) for n in names)
    return {k: parquet(spark, f"{sf_dir}/{t}.parquet") for k, t in pairs}


def _plan(name: str, tables, steps: list[dict], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).over(_tables(spark, sf_dir, tables), steps).visible

    QUERIES[name], ORACLE_SQL[name] = run, sql


_F = lambda f: {"field": f}
_V = lambda v: {"value": v}
_round = lambda f, d=2: {"op": "derive", "field": f, "expr": {"round": [_F(f), d]}}
_select = lambda *f: {"op": "select", "fields": list(f)}
_as = lambda f, a: {"field": f, "as": a}

_plan(
    "flagship_revenue", {"li": "lineitem", "o": "orders"},
    [
        {"id": "kept", "op": "filter", "source": "li", "where": {"all": [{"field": "l_returnflag", "eq": "R"}, {"field": "l_quantity", "gte": 30}]}},
        {"id": "priced", "op": "derive", "field": "revenue", "expr": {"multiply": [_F("l_extendedprice"), {"subtract": [_V(1), _F("l_discount")]}]}},
        {"id": "joined", "op": "join", "left": "priced", "right": "o", "on": [["l_orderkey", "o_orderkey"]]},
        {"op": "group", "by": ["o_orderpriority"], "aggregates": [{"op": "sum", "field": "revenue", "as": "revenue"}, {"op": "count", "as": "n"}]},
        _round("revenue"), {"op": "sort", "by": [{"field": "revenue", "direction": "desc"}]},
    ],
    "select o_orderpriority, cast(count(*) as bigint) as n, round(sum(l_extendedprice*(1-l_discount)),2) as revenue from lineitem join orders on l_orderkey=o_orderkey where l_returnflag='R' and l_quantity>=30 group by 1",
)
_plan("filter_cmp", ["orders"], [{"op": "filter", "where": {"all": [{"field": "o_totalprice", "gt": 1000.5}, {"field": "o_totalprice", "lte": 400000}, {"field": "o_orderpriority", "gte": "2-HIGH"}, {"field": "o_orderpriority", "lt": "5-LOW"}, {"field": "o_orderstatus", "ne": "P"}]}}, _select("o_orderkey", "o_orderstatus")],
      "select o_orderkey, o_orderstatus from orders where o_totalprice > 1000.5 and o_totalprice <= 400000 and o_orderpriority >= '2-HIGH' and o_orderpriority < '5-LOW' and o_orderstatus <> 'P'")
_plan("filter_in_not_in", ["orders"], [{"op": "filter", "where": {"all": [{"field": "o_orderstatus", "in": ["F", "P"]}, {"field": "o_orderpriority", "not_in": ["1-URGENT", "5-LOW"]}]}}, _select("o_orderkey", "o_orderpriority")],
      "select o_orderkey, o_orderpriority from orders where o_orderstatus in ('F','P') and o_orderpriority not in ('1-URGENT','5-LOW')")
_plan("filter_not_in_null", ["orders"], [{"op": "filter", "where": {"field": "o_orderstatus", "not_in": ["F", None]}}, _select("o_orderkey")], "select o_orderkey from orders where o_orderstatus not in ('F', null)")
_plan("filter_strings", ["part"], [{"op": "filter", "where": {"any": [{"field": "p_name", "contains": "a"}, {"field": "p_brand", "starts_with": "Brand#1"}, {"field": "p_type", "ends_with": "L"}]}}, _select("p_partkey", "p_name")],
      "select p_partkey, p_name from part where contains(p_name,'a') or starts_with(p_brand,'Brand#1') or ends_with(p_type,'L')")
_plan("filter_boolean_tree", ["lineitem"], [{"op": "filter", "where": {"not": {"any": [{"all": [{"field": "l_quantity", "lt": 25}, {"field": "l_returnflag", "eq": "N"}]}, {"field": "l_linestatus", "eq": "O"}]}}}, {"op": "group", "by": ["l_returnflag"], "aggregates": [{"op": "count"}]}],
      "select l_returnflag, cast(count(*) as bigint) as count_rows from lineitem where not ((l_quantity < 25 and l_returnflag='N') or l_linestatus='O') group by 1")
_NULLS = [{"id": "big", "op": "filter", "source": "orders", "where": {"field": "o_totalprice", "gt": 400000}}, {"id": "both", "op": "join", "left": "customer", "right": "big", "type": "left", "on": [["c_custkey", "o_custkey"]]}]
_LEFT = "customer left join (select * from orders where o_totalprice > 400000) o on c_custkey = o_custkey"
for _name, _where, _sql in (("eq", {"field": "o_orderstatus", "eq": "F"}, "o_orderstatus = 'F'"), ("ne", {"field": "o_orderstatus", "ne": "F"}, "o_orderstatus <> 'F'"), ("is_null", {"field": "o_orderkey", "is_null": True}, "o_orderkey is null"), ("not_null", {"field": "o_orderkey", "not_null": True}, "o_orderkey is not null"), ("eq_null", {"field": "o_orderkey", "eq": None}, "o_orderkey is null"), ("not", {"not": {"field": "o_orderstatus", "eq": "F"}}, "not (o_orderstatus = 'F')")):
    _plan(f"filter_null_semantics_{_name}", ["customer", "orders"], [*_NULLS, {"op": "filter", "where": _where}, _select("c_custkey", "o_orderkey")], f"select c_custkey, o_orderkey from {_LEFT} where {_sql}")
_plan("select_rename_drop", ["nation"], [_select("n_nationkey", _as("n_name", "name"), "n_regionkey"), {"op": "rename", "fields": {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"}}, {"op": "drop", "fields": ["n_nationkey"]}],
      "select n_nationkey as n_regionkey, n_name as name from nation")
_plan("derive_replace_moves_last", ["customer"], [_select("c_custkey", "c_name", "c_acctbal"), {"op": "derive", "field": "c_name", "expr": {"upper": _F("c_name")}}], "select c_custkey, c_acctbal, upper(c_name) as c_name from customer")
_plan("derive_arith", ["lineitem"], [{"op": "derive", "field": "net", "expr": {"multiply": [_F("l_extendedprice"), {"subtract": [_V(1), _F("l_discount")]}, {"add": [_V(1), _F("l_tax")]}]}}, _round("net"), {"op": "derive", "field": "k", "expr": {"subtract": [{"multiply": [_F("l_orderkey"), _V(10)]}, _F("l_linenumber"), _V(3)]}}, _select("l_orderkey", "l_linenumber", "net", "k")],
      "select l_orderkey, l_linenumber, round(l_extendedprice*(1-l_discount)*(1+l_tax),2) as net, l_orderkey*10-l_linenumber-3 as k from lineitem")
_plan("derive_divide", ["lineitem"], [{"op": "derive", "field": "unit", "expr": {"divide": [_F("l_extendedprice"), _F("l_quantity")]}}, {"op": "derive", "field": "half", "expr": {"divide": [_F("l_orderkey"), _V(2)]}}, _select("l_orderkey", "l_linenumber", "unit", "half")],
      "select l_orderkey, l_linenumber, l_extendedprice/l_quantity as unit, l_orderkey/2 as half from lineitem")
_plan("derive_concat_nulls", ["customer", "orders"], [*_NULLS, {"op": "derive", "field": "tag", "expr": {"concat": [_F("c_name"), _V("/"), _F("o_orderstatus"), _F("o_orderkey")]}}, _select("c_custkey", "tag")], f"select c_custkey, concat(c_name, '/', o_orderstatus, o_orderkey) as tag from {_LEFT}")
_plan("derive_coalesce", ["customer", "orders"], [*_NULLS, {"op": "derive", "field": "price", "expr": {"coalesce": [_F("o_totalprice"), _F("c_acctbal")]}}, {"op": "derive", "field": "status", "expr": {"coalesce": [_F("o_orderstatus"), _V("none")]}}, _select("c_custkey", "price", "status")],
      f"select c_custkey, coalesce(o_totalprice, c_acctbal) as price, coalesce(o_orderstatus,'none') as status from {_LEFT}")
_plan("derive_string", ["part"], [{"op": "derive", "field": "low", "expr": {"lower": _F("p_name")}}, {"op": "derive", "field": "mid", "expr": {"substring": [_F("p_name"), 2, 4]}}, {"op": "derive", "field": "tail", "expr": {"substring": [_F("p_name"), -3]}}, {"op": "derive", "field": "zero", "expr": {"substring": [_F("p_name"), 0, 2]}}, _select("p_partkey", "low", "mid", "tail", "zero")],
      "select p_partkey, lower(p_name) as low, substring(p_name,2,4) as mid, substring(p_name,-3) as tail, substring(p_name,0,2) as zero from part")
_plan("derive_round", ["customer"], [{"op": "derive", "field": "r0", "expr": {"round": _F("c_acctbal")}}, {"op": "derive", "field": "r1", "expr": {"round": [_F("c_acctbal"), 1]}}, {"op": "derive", "field": "tens", "expr": {"round": [_F("c_custkey"), -1]}}, _select("c_custkey", "r0", "r1", "tens")],
      "select c_custkey, round(c_acctbal) as r0, round(c_acctbal,1) as r1, round(c_custkey,-1) as tens from customer")
_plan("cast_all", ["orders"], [{"op": "derive", "field": "key_text", "expr": _F("o_orderkey")}, {"op": "derive", "field": "day", "expr": _F("o_orderdate")}, {"op": "derive", "field": "n", "expr": _F("o_custkey")}, {"op": "derive", "field": "flag", "expr": _V("yes")}, {"op": "cast", "fields": {"key_text": "string", "day": "date", "n": "double", "flag": "boolean"}}, {"op": "cast", "field": "day", "to": "string"}, _select("o_orderkey", "key_text", "day", "n", "flag")],
      "select o_orderkey, cast(o_orderkey as varchar) as key_text, cast(cast(o_orderdate as date) as varchar) as day, cast(o_custkey as double) as n, true as flag from orders")
_plan("cast_rounding", ["lineitem"], [{"op": "derive", "field": "half", "expr": {"divide": [_F("l_linenumber"), _V(2)]}}, {"op": "derive", "field": "text", "expr": {"concat": [_F("l_linenumber"), _V(".5")]}}, {"op": "cast", "fields": {"half": "bigint", "text": "bigint"}}, _select("l_orderkey", "l_linenumber", "half", "text")],
      "select l_orderkey, l_linenumber, cast(l_linenumber/2 as bigint) as half, cast(l_linenumber || '.5' as bigint) as text from lineitem")


@_code("cast_lossy_report", "select cast(count(*) filter (where cast(cast(c_acctbal as bigint) as double) <> c_acctbal) as bigint) as c_acctbal from customer")
def _lossy(spark, sf_dir):
    return rows.lossy_counts(parquet(spark, f"{sf_dir}/customer.parquet"), {"op": "cast", "field": "c_acctbal", "to": "bigint"})


@_code("explode_embedding", "select vec_id, label, cast(unnest(range(len(embedding))) as bigint) as pos, cast(unnest(embedding) as double) as embedding from embeddings")
def _explode(spark, sf_dir):
    frame = Engine(spark).over(_tables(spark, sf_dir, ["embeddings"]), [{"op": "explode", "field": "embedding"}])
    return frame.df.select("vec_id", "label", F.col(frame.order[-1].name).cast("long").alias("pos"), F.col("embedding").cast("double").alias("embedding"))


_plan("pivot_sum", ["orders"], [{"op": "pivot", "by": ["o_orderstatus"], "field": "o_orderpriority", "value": "o_custkey", "values": ["1-URGENT", "2-HIGH", "9-ABSENT"], "aliases": {"1-URGENT": "urgent", "2-HIGH": "high", "9-ABSENT": "absent"}}, {"op": "cast", "fields": {"urgent": "bigint", "high": "bigint", "absent": "bigint"}}],
      "select o_orderstatus, cast(sum(o_custkey) filter (where o_orderpriority='1-URGENT') as bigint) as urgent, cast(sum(o_custkey) filter (where o_orderpriority='2-HIGH') as bigint) as high, cast(sum(o_custkey) filter (where o_orderpriority='9-ABSENT') as bigint) as absent from orders group by 1")
_plan("pivot_count_zero", ["orders"], [{"op": "pivot", "by": ["o_orderpriority"], "field": "o_orderstatus", "value": "o_custkey", "values": ["F", "X"], "aggregate": "count"}],
      "select o_orderpriority, cast(count(*) filter (where o_orderstatus='F') as bigint) as \"F\", cast(count(*) filter (where o_orderstatus='X') as bigint) as \"X\" from orders group by 1")
_plan("pivot_no_by", ["orders"], [{"op": "pivot", "field": "o_orderstatus", "value": "o_totalprice", "values": ["F", "O"], "aggregate": "max"}], "select max(o_totalprice) filter (where o_orderstatus='F') as \"F\", max(o_totalprice) filter (where o_orderstatus='O') as \"O\" from orders")
_plan("unpivot_measures", ["lineitem"], [{"op": "unpivot", "fields": ["l_quantity", "l_discount", "l_tax"], "keep": ["l_orderkey", "l_linenumber"], "name_field": "measure", "value_field": "amount"}],
      "select l_orderkey, l_linenumber, 'l_quantity' as measure, l_quantity as amount from lineitem union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem")
_plan("unpivot_mixed_types", ["nation"], [{"op": "unpivot", "fields": ["n_name", "n_regionkey"], "keep": ["n_nationkey"]}], "select n_nationkey, 'n_name' as field, n_name as value from nation union all select n_nationkey, 'n_regionkey', cast(n_regionkey as varchar) from nation")


def _nested(spark, sf_dir) -> Frame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return Frame(df.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("key")).alias("nation")).alias("who")))


@_code("flatten_nested", "select c_custkey, c_name as who_name, c_nationkey as who_nation_key from customer")
def _flatten(spark, sf_dir):
    return Engine(spark).over({"t": _nested(spark, sf_dir)}, [{"op": "flatten", "separator": "."}, {"op": "rename", "fields": {"who.name": "who_name", "who.nation.key": "who_nation_key"}}]).visible


@_code("unflatten_roundtrip", "select c_custkey, c_name as name, c_nationkey as key from customer")
def _unflatten(spark, sf_dir):
    steps = [{"op": "flatten", "separator": "."}, {"op": "unflatten", "separator": "."}, _select("c_custkey", "who.name", _as("who.nation.key", "key"))]
    return Engine(spark).over({"t": _nested(spark, sf_dir)}, steps).visible


_SIDES = [{"id": "l", "op": "filter", "source": "customer", "where": {"field": "c_acctbal", "lt": 5000}}, {"id": "r", "op": "filter", "source": "orders", "where": {"field": "o_totalprice", "gte": 100000}}]
for _how in ("inner", "left", "right", "full"):
    _plan(f"join_{_how}", ["customer", "orders"], [*_SIDES, {"op": "join", "left": "l", "right": "r", "type": _how, "on": [["c_custkey", "o_custkey"]]}, _select("c_custkey", "c_name", "o_orderkey", "o_custkey")],
          f"select c_custkey, c_name, o_orderkey, o_custkey from (select * from customer where c_acctbal < 5000) {_how} join (select * from orders where o_totalprice >= 100000) on c_custkey = o_custkey")
_plan("join_multi_key", ["lineitem", "orders"], [{"id": "o", "op": "derive", "source": "orders", "field": "line", "expr": _V(1)}, {"op": "join", "left": "lineitem", "right": "o", "on": [["l_orderkey", "o_orderkey"], ["l_linenumber", "line"]]}, _select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")],
      "select l_orderkey, l_linenumber, l_partkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey and l_linenumber = 1")
_plan("join_collision_prefix", {"a": "nation", "b": "nation"}, [{"op": "join", "left": "a", "right": "b", "on": [["n_regionkey", "n_nationkey"]], "right_prefix": "up_"}],
      "select a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey as up_n_nationkey, b.n_name as up_n_name, b.n_regionkey as up_n_regionkey from nation a join nation b on a.n_regionkey = b.n_nationkey")


@_code("join_effects", """with l as (select * from customer where c_acctbal < 5000), r as (select * from orders where o_totalprice >= 100000),
lc as (select c_custkey k, count(*) n from l group by 1), rc as (select o_custkey k, count(*) n from r group by 1)
select cast(coalesce(sum(case when lc.k is not null and rc.k is not null then lc.n*rc.n end),0) as bigint) as matched_pairs, cast(coalesce(sum(case when rc.k is not null then lc.n end),0) as bigint) as left_matched,
cast(coalesce(sum(case when lc.k is not null then rc.n end),0) as bigint) as right_matched, cast(coalesce(sum(case when rc.k is null then lc.n end),0) as bigint) as left_unmatched,
cast(coalesce(sum(case when lc.k is null then rc.n end),0) as bigint) as right_unmatched, cast(coalesce(sum(case when rc.n > 1 then lc.n end),0) as bigint) as left_fanout
from lc full join rc on lc.k = rc.k""")
def _effects(spark, sf_dir):
    t = _tables(spark, sf_dir, ["customer", "orders"])
    left, right = (rows.filter_(t[s["source"]], s) for s in _SIDES)
    return groups.join_effects(left, right, {"on": [["c_custkey", "o_custkey"]]})


_AGGS = [{"op": "count", "as": "n"}, {"op": "count", "field": "value", "as": "n_value"}, {"op": "count_distinct", "field": "event_type", "as": "types"}, {"op": "sum", "field": "event_id", "as": "total"}, {"op": "avg", "field": "event_id", "as": "mean"}, {"op": "min", "field": "value", "as": "low"}, {"op": "max", "field": "value", "as": "high"}, {"op": "first", "field": "event_type", "as": "first_type"}, {"op": "last", "field": "event_type", "as": "last_type"}]
_AGG_SQL = "cast(count(*) as bigint) as n, cast(count(value) as bigint) as n_value, cast(count(distinct event_type) as bigint) as types, cast(sum(event_id) as bigint) as total, round(avg(event_id),4) as mean, min(value) as low, max(value) as high, arg_min(event_type, event_id) as first_type, arg_max(event_type, event_id) as last_type"
_BY_ID = {"op": "sort", "by": ["event_id"]}
_plan("group_all_aggregates", ["events"], [_BY_ID, {"op": "group", "by": ["user_id"], "aggregates": _AGGS}, {"op": "cast", "field": "total", "to": "bigint"}, _round("mean", 4)], f"select user_id, {_AGG_SQL} from events group by 1")
_plan("group_global_empty", ["events"], [{"op": "filter", "where": {"field": "event_id", "lt": -1}}, {"op": "group", "aggregates": [{"op": "count", "as": "n"}, {"op": "max", "field": "value", "as": "high"}]}], "select cast(count(*) as bigint) as n, max(value) as high from events where event_id < -1")
_plan("group_first_last_desc", ["events"], [{"op": "sort", "by": [{"field": "event_id", "direction": "desc"}]}, {"op": "group", "by": [_as("event_type", "kind")], "aggregates": [{"op": "first", "field": "user_id"}, {"op": "last", "field": "user_id"}]}],
      "select event_type as kind, arg_max(user_id, event_id) as first_user_id, arg_min(user_id, event_id) as last_user_id from events group by 1")
_plan("group_count_distinct", ["lineitem"], [{"op": "group", "by": ["l_returnflag", "l_linestatus"], "aggregates": [{"op": "count_distinct", "field": "l_partkey"}, {"op": "count_distinct", "field": "l_suppkey"}]}],
      "select l_returnflag, l_linestatus, cast(count(distinct l_partkey) as bigint) as count_distinct_l_partkey, cast(count(distinct l_suppkey) as bigint) as count_distinct_l_suppkey from lineitem group by 1, 2")


@_code("sort_nulls_last", f"select c_custkey, o_orderkey, cast(row_number() over (order by o_orderkey desc nulls last, c_custkey asc nulls last) as bigint) as place from {_LEFT}")
def _sort(spark, sf_dir):
    frame = Engine(spark).over(_tables(spark, sf_dir, ["customer", "orders"]), [*_NULLS, {"op": "sort", "by": [{"field": "o_orderkey", "direction": "desc"}, "c_custkey"]}])
    return frame.numbered("place").select("c_custkey", "o_orderkey", "place")


_plan("sort_limit_offset", ["orders"], [{"op": "sort", "by": [{"field": "o_totalprice", "direction": "desc"}, "o_orderkey"]}, {"op": "limit", "count": 40, "offset": 15}, _select("o_orderkey", "o_totalprice")], "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 40 offset 15")
_plan("topk", ["lineitem"], [{"op": "group", "by": ["l_suppkey"], "aggregates": [{"op": "count", "as": "n"}]}, {"op": "sort", "by": [{"field": "n", "direction": "desc"}, "l_suppkey"]}, {"op": "limit", "count": 10}], "select l_suppkey, cast(count(*) as bigint) as n from lineitem group by 1 order by n desc, l_suppkey limit 10")
for _keep, _dir in (("first", "asc"), ("last", "desc")):
    _plan(f"dedupe_{_keep}", ["orders"], [{"op": "sort", "by": ["o_orderkey"]}, {"op": "dedupe", "fields": ["o_custkey"], "keep": _keep}, _select("o_custkey", "o_orderkey", "o_orderstatus")],
          f"select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey {_dir}) = 1")
_plan("dedupe_null_keys", ["customer", "orders"], [*_NULLS, {"op": "sort", "by": ["c_custkey", "o_orderkey"]}, {"op": "dedupe", "fields": ["o_orderstatus", "c_nationkey"]}, _select("c_custkey", "o_orderkey")],
      f"select c_custkey, o_orderkey from {_LEFT} qualify row_number() over (partition by o_orderstatus, c_nationkey order by c_custkey, o_orderkey nulls last) = 1")

_TREE = [{"op": "set", "path": "meta.seen", "value": 1, "create": True}, {"op": "merge", "value": {"extra": {"a": [1, 2]}, "k2": "x"}}, {"op": "delete", "path": "extra.a[0]"}]


@_code("tree_set_delete_merge", "select event_id, cast(json_extract_string(props, '$.k') as varchar) as k, '1' as seen, '[2]' as a, 'x' as k2 from events")
def _tree(spark, sf_dir):
    doc = trees.edited_column(F.col("props"), _TREE)
    got = lambda p: F.get_json_object("doc", p)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", doc.alias("doc")).select("event_id", got("$.k").alias("k"), got("$.meta.seen").alias("seen"), got("$.extra.a").alias("a"), got("$.k2").alias("k2"))


@_code("tree_flatten", "select event_id, cast(json_extract_string(props, '$.k') as varchar) as v from events")
def _tree_flat(spark, sf_dir):
    doc = trees.edited_column(F.col("props"), [{"op": "set", "path": "in", "value": {"side": 7}, "create": True}, {"op": "flatten"}])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", doc.alias("doc")).where(F.get_json_object("doc", "$.in_side") == "7").select("event_id", F.get_json_object("doc", "$.k").alias("v"))


@_code("assert_metrics", "select cast(count(*) as bigint) as rows, cast(count(*) filter (where l_partkey is null) as bigint) as null_rows_0 from lineitem")
def _metrics(spark, sf_dir):
    return checks.metrics(parquet(spark, f"{sf_dir}/lineitem.parquet"), [{"type": "not_null", "field": "l_partkey"}])


@_code("assert_unique_groups", "select cast(count(*) as bigint) as duplicate_groups from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)")
def _unique(spark, sf_dir):
    return checks.duplicate_groups(parquet(spark, f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


_SCHEMA = {"type": "object", "required": ["p_partkey"], "properties": {"p_partkey": {"type": "integer", "minimum": 10}, "p_size": {"type": "integer", "maximum": 40, "multipleOf": 2}, "p_name": {"type": "string", "minLength": 3}, "p_brand": {"enum": ["Brand#11", "Brand#12", "Brand#13"]}}}


@_code("schema_validate_counts", "select cast(count(*) as bigint) as rows, cast(count(*) filter (where p_partkey < 10 or p_size > 40 or p_size % 2 <> 0 or length(p_name) < 3 or p_brand not in ('Brand#11','Brand#12','Brand#13')) as bigint) as bad from part")
def _schema(spark, sf_dir):
    frame = parquet(spark, f"{sf_dir}/part.parquet")
    failing = checks.row_failures(frame, _SCHEMA).select(*frame.carried()).distinct().agg(F.count(F.lit(1)).alias("bad"))
    return frame.df.agg(F.count(F.lit(1)).alias("rows")).select("rows", failing.scalar().alias("bad"))


@_code("schema_row_failures", "select keyword, cast(count(*) as bigint) as n from (select 'minimum' as keyword from part where p_partkey < 10 union all select 'maximum' from part where p_size > 40 union all select 'multipleOf' from part where p_size % 2 <> 0 union all select 'enum' from part where p_brand not in ('Brand#11','Brand#12','Brand#13')) group by 1")
def _schema_rows(spark, sf_dir):
    return checks.row_failures(parquet(spark, f"{sf_dir}/part.parquet"), _SCHEMA).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


_CHANGED = "select o_orderkey, o_custkey, case when o_totalprice > 420000 then 'X' else o_orderstatus end as o_orderstatus from orders where o_totalprice >= 40000 union all select -1 - o_orderkey, o_custkey, o_orderstatus from orders where o_orderpriority = '3-MEDIUM'"


def _two(spark, sf_dir):
    """The orders, and the orders with some rows changed, some gone and some added."""
    orders, names = spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderkey", "o_custkey", "o_orderstatus"]
    changed = orders.where("o_totalprice >= 40000").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 420_000, "X").otherwise(F.col("o_orderstatus")))
    more = orders.where("o_orderpriority = '3-MEDIUM'").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return Frame(orders.select(*names)), Frame(changed.select(*names).union(more.select(*names)))


@_code("diff_keyed", f"with r as ({_CHANGED}) select coalesce(l.o_orderkey, r.o_orderkey) as o_orderkey, case when l.o_orderkey is null then 'added' when r.o_orderkey is null then 'removed' else 'changed' end as state from orders l full join r on l.o_orderkey = r.o_orderkey where l.o_orderkey is null or r.o_orderkey is null or l.o_custkey is distinct from r.o_custkey or l.o_orderstatus is distinct from r.o_orderstatus")
def _diff(spark, sf_dir):
    return differ.keyed(*_two(spark, sf_dir), ["o_orderkey"])


@_code("diff_unkeyed", f"with r as (select o_custkey, o_orderstatus from ({_CHANGED})), b as (select o_custkey, o_orderstatus, -1 as n from orders union all select o_custkey, o_orderstatus, 1 from r) select o_custkey, o_orderstatus, cast(sum(n) as bigint) as surplus from b group by 1, 2 having sum(n) <> 0")
def _bag(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return differ.unkeyed(Frame(left.df.drop("o_orderkey")), Frame(right.df.drop("o_orderkey")))


@_code("profile_nulls", f"select cast(count(*) as bigint) as rows, cast(count(*) - count(c_custkey) as bigint) as nulls_c_custkey, cast(count(*) - count(o_orderkey) as bigint) as nulls_o_orderkey from {_LEFT}")
def _profile(spark, sf_dir):
    return profile.null_counts(Engine(spark).over(_tables(spark, sf_dir, ["customer", "orders"]), [*_NULLS, _select("c_custkey", "o_orderkey")]))


@_code("parquet_roundtrip", "select p_partkey, p_name, p_size, p_retailprice from part")
def _rt_parquet(spark, sf_dir):
    frame = Engine(spark).over(_tables(spark, sf_dir, ["part"]), [_select("p_partkey", "p_name", "p_size", "p_retailprice")])
    sinks.write_directory(frame, to := _folder(spark), "parquet")
    return parquet(spark, to).visible


@_code("jsonl_roundtrip", "select p_partkey, p_name, p_size from part")
def _rt_jsonl(spark, sf_dir):
    frame = Engine(spark).over(_tables(spark, sf_dir, ["part"]), [_select("p_partkey", "p_name", "p_size")])
    sinks.write_directory(frame, to := _folder(spark), "jsonl")
    return jsonl(spark, to).visible


@_code("csv_roundtrip", "select p_partkey, p_name, cast(p_size as bigint) as p_size from part")
def _rt_csv(spark, sf_dir):
    from pathlib import Path

    frame = Engine(spark).over(_tables(spark, sf_dir, ["part"]), [_select("p_partkey", "p_name", "p_size")])
    to = Path(_folder(spark).removeprefix("file://"))
    sinks.publish("table", frame, None, to.with_suffix(".csv"), "csv", False)
    return delimited(spark, str(to.with_suffix(".csv")), ",").visible


@_code("stream_rowlocal", "select event_id, value * 2 as double_value from events where event_type <> 'click'")
def _stream(spark, sf_dir):
    from quillframe.streaming.rowlocal import on_stream

    # a file stream over the table's folder, run to its end
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = on_stream(stream, [{"op": "filter", "where": {"field": "event_type", "ne": "click"}}, {"op": "derive", "field": "double_value", "expr": {"multiply": [_F("value"), _V(2)]}}, _select("event_id", "double_value")])
    to = _folder(spark)
    query = out.writeStream.format("parquet").option("checkpointLocation", to + "-state").trigger(availableNow=True).start(to)
    query.awaitTermination()
    return spark.read.schema("event_id long, double_value double").parquet(to)
