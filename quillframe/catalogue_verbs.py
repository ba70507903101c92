"""Catalogue queries that go through the four verbs and the file carriers, each a table of what the verb reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.plans import checks
from quillframe.plans.engine import Engine
from quillframe.registry import code, folder
from quillframe.sources import trees
from quillframe.sources.readers import parquet


def _here(spark: SparkSession) -> Path:
    """A fresh local folder for files the driver writes."""
    to = Path(folder(spark).removeprefix("file://"))
    to.mkdir(parents=True)
    return to


def _engine(spark: SparkSession, root) -> Engine:
    return Engine(spark, root=str(root), enforce_limits=False)


def _plan(sources: dict, steps: list[dict], **more) -> dict:
    return {"version": "1", "sources": sources, "steps": steps, **more}


def _fields(*names: str) -> dict:
    return {"op": "select", "fields": list(names)}


def _report(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).coalesce(1)


def _done(found: dict) -> dict:
    if found["status"] == "error":
        raise RuntimeError(str(found["error"]))
    return found


def _carried(name: str, table: str, suffix: str, columns: list[str], sql: str) -> None:
    """A table written as a file by ``transform`` and read back as a source of the next plan, its format by its suffix."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        to = _here(spark)
        plan = _plan({"t": {"path": str(Path(sf_dir).resolve() / f"{table}.parquet")}}, [_fields(*columns)], output={"path": str(to / f"table.{suffix}")})
        _done(Engine(spark, enforce_limits=False).transform(plan))
        return _engine(spark, to).query(_plan({"t": {"path": f"table.{suffix}"}}, [_fields(*columns)]))

    code(name, sql)(run)


_carried("tsv_roundtrip", "part", "tsv", ["p_partkey", "p_name", "p_size"], "select p_partkey, p_name, cast(p_size as bigint) as p_size from part")
_carried("json_roundtrip", "customer", "json", ["c_custkey", "c_name", "c_mktsegment"], "select c_custkey, c_name, c_mktsegment from customer")
_carried("yaml_roundtrip", "supplier", "yaml", ["s_suppkey", "s_name"], "select s_suppkey, s_name from supplier")


@code("format_by_suffix", "select suffix, r_name from region cross join (values ('json'), ('jsonl'), ('ndjson'), ('yaml'), ('yml'), ('csv'), ('tsv'), ('parquet'), ('given')) as s(suffix)")
def _suffixes(spark, sf_dir):
    to, parts = _here(spark), []
    source = {"r": {"path": str(Path(sf_dir).resolve() / "region.parquet")}}
    for suffix in ("json", "jsonl", "ndjson", "yaml", "yml", "csv", "tsv", "parquet", "given"):
        given = {"format": "csv"} if suffix == "given" else {}
        _done(Engine(spark).transform(_plan(source, [_fields("r_name")], output={"path": str(to / f"r.{suffix}"), **given})))
        parts.append(_engine(spark, to).query(_plan({"r": {"path": f"r.{suffix}", **given}}, [_fields("r_name")])).select(F.lit(suffix).alias("suffix"), "r_name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@code("inline_source", "select n_nationkey, n_name, z.label from nation join (values (1, 'west'), (3, 'old')) as z(k, label) on n_regionkey = z.k")
def _inline(spark, sf_dir):
    steps = [{"op": "join", "left": "n", "right": "z", "on": [["n_regionkey", "k"]]}, _fields("n_nationkey", "n_name", "label")]
    return _engine(spark, sf_dir).query(_plan({"n": {"path": "nation.parquet"}, "z": {"inline": [{"k": 1, "label": "west"}, {"k": 3, "label": "old"}]}}, steps))


@code("selector_source", "select form, n_name from nation cross join (values ('d.rows'), ('$.d.rows'), ('$.d.rows[*]'), (' d.rows ')) as s(form)")
def _selectors(spark, sf_dir):
    """The nations as a document with nested rows, read by several spellings of one selector."""
    import json

    to, out = _here(spark), None
    nations = _done(_engine(spark, sf_dir).transform(_plan({"n": {"path": "nation.parquet"}}, [_fields("n_name")])))["result"]["data"]
    (to / "nested.json").write_text(json.dumps({"d": {"rows": nations}, "other": 1}))
    for form in ("d.rows", "$.d.rows", "$.d.rows[*]", " d.rows "):
        got = _engine(spark, to).query(_plan({"n": {"path": "nested.json", "select": form}}, [_fields("n_name")])).select(F.lit(form).alias("form"), "n_name")
        out = got if out is None else out.union(got)
    return out


_CHAIN = [
    {"id": "returned", "op": "filter", "source": "l", "where": {"field": "l_returnflag", "eq": "R"}},
    {"id": "slim", "op": "select", "fields": ["l_orderkey", "l_quantity"]},
    {"id": "once", "op": "dedupe", "fields": ["l_orderkey"]},
    {"id": "named", "op": "join", "left": "once", "right": "o", "on": [["l_orderkey", "o_orderkey"]]},
]
_ONCE = "(select count(distinct l_orderkey) from lineitem where l_returnflag = 'R')"
_RETURNED = "(select count(*) from lineitem where l_returnflag = 'R')"


@code("transform_effects", f"select 'returned' as id, 'filter' as op, (select count(*) from lineitem) as rows_in, {_RETURNED} as rows_out, {_RETURNED} - (select count(*) from lineitem) as rows_delta, '' as removed union all select 'slim', 'select', {_RETURNED}, {_RETURNED}, 0, (select string_agg(column_name, ',' order by column_name) from (describe lineitem) where column_name not in ('l_orderkey', 'l_quantity')) union all select 'once', 'dedupe', {_RETURNED}, {_ONCE}, {_ONCE} - {_RETURNED}, '' union all select 'named', 'join', {_ONCE}, (select count(*) from (select distinct l_orderkey from lineitem where l_returnflag = 'R') join orders on l_orderkey = o_orderkey), (select count(*) from (select distinct l_orderkey from lineitem where l_returnflag = 'R') join orders on l_orderkey = o_orderkey) - {_ONCE}, ''")
def _effects(spark, sf_dir):
    found = _done(_engine(spark, sf_dir).transform(_plan({"l": {"path": "lineitem.parquet"}, "o": {"path": "orders.parquet"}}, _CHAIN, **{"return": {"mode": "summary"}})))
    rows = [(s["id"], s["op"], s["rows_in"], s["rows_out"], s["rows_delta"], ",".join(sorted(s["fields_removed"]))) for s in found["execution_effects"]["steps"]]
    return _report(spark, rows, "id string, op string, rows_in long, rows_out long, rows_delta long, removed string")


@code("transform_return_modes", "select * from (values ('auto', 'ok', 'inline'), ('summary', 'ok', 'summary'), ('reference', 'ok', 'file'), ('dry', 'dry_run', 'summary')) as m(mode, status, kind), (select count(*) as rows_out from nation where n_regionkey = 2), (select count(*) as files from (values (1)))")
def _modes(spark, sf_dir):
    """A plan under each return mode and as a dry run; only the mode with an output that is not dry leaves a file."""
    to, rows = _here(spark), []
    source = {"n": {"path": str(Path(sf_dir).resolve() / "nation.parquet")}}
    steps = [{"op": "filter", "where": {"field": "n_regionkey", "eq": 2}}]
    for mode in ("auto", "summary", "reference", "dry"):
        target = {"output": {"path": str(to / f"{mode}.jsonl")}} if mode in ("reference", "dry") else {}
        found = _done(Engine(spark).transform(_plan(source, steps, **target, **{"return": {"mode": "auto" if mode == "dry" else mode}}), dry_run=mode == "dry"))
        rows.append((mode, found["status"], found["result"]["kind"], found["summary"]["rows_out"]))
    files = len(list(to.iterdir()))
    return _report(spark, [(*r, files) for r in rows], "mode string, status string, kind string, rows_out long, files long")


@code("published_digest", "select cast(strlen(body) as bigint) as bytes, sha256(body) as sha256 from (select string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' || chr(10), '' order by r_regionkey) as body from region)")
def _published(spark, sf_dir):
    """Size and SHA-256 of a published JSONL file, of its whole bytes."""
    to = _here(spark)
    found = _done(Engine(spark).transform(_plan({"r": {"path": str(Path(sf_dir).resolve() / "region.parquet")}}, [_fields("r_regionkey", "r_name")], output={"path": str(to / "r.jsonl")})))
    return _report(spark, [(found["result"]["bytes"], found["result"]["sha256"])], "bytes long, sha256 string")


_KEEP = [{"op": "limit", "count": 3}]
_EMPTY = [{"op": "limit", "count": 0}]


@code("refusals", """select * from (values
  ('output exists', 'E_OUTPUT_EXISTS'), ('no folder', 'E_OUTPUT_DIRECTORY'), ('outside', 'E_PATH_OUTSIDE_WORKSPACE'), ('network', 'E_NETWORK_FORBIDDEN'),
  ('no file', 'E_SOURCE_NOT_FOUND'), ('empty as json', 'E_OUTPUT_SCHEMA_LOSS'), ('tree as csv', 'E_OUTPUT_INVALID'), ('reference without output', 'E_OUTPUT_REQUIRED'),
  ('unknown key', 'E_PLAN_INVALID'), ('bad condition', 'E_CONDITION_INVALID'), ('bad expression', 'E_EXPRESSION_INVALID'), ('no field', 'E_FIELD_NOT_FOUND'),
  ('limit too high', 'E_LIMIT_INVALID'), ('rows over budget', 'E_ROW_LIMIT'), ('items over budget', 'E_ITEM_LIMIT'), ('key types', 'E_TYPE_MISMATCH'), ('path not found', 'E_PATH_NOT_FOUND'),
  ('step on a tree', 'E_UNKNOWN_OPERATION'), ('assertion', 'E_ASSERTION_FAILED'), ('schema', 'E_SCHEMA_FAILED')) as c(case_name, error)""")
def _refusals(spark, sf_dir):
    """Plans that must be refused, each with its stable code."""
    to = _here(spark)
    (to / "there.csv").write_text("x\n")
    (to / "n.csv").write_text("k,t\n1,a\n2,b\n3,c\n4,d\n")
    table, tree = {"n": {"path": "n.csv"}}, {"t": {"inline": {"a": {"b": 1}}, "kind": "tree"}}
    where = lambda w: [{"op": "filter", "where": w}]
    cases = {
        "output exists": _plan(table, _KEEP, output={"path": "there.csv"}),
        "no folder": _plan(table, _KEEP, output={"path": "none/x.csv"}),
        "outside": _plan({"n": {"path": "../n.csv"}}, _KEEP),
        "network": _plan({"n": {"path": "http://host/n.csv"}}, _KEEP),
        "no file": _plan({"n": {"path": "gone.csv"}}, _KEEP),
        "empty as json": _plan(table, _EMPTY, output={"path": "e.json"}),
        "tree as csv": _plan(tree, [{"op": "set", "path": "a.b", "value": 2}], output={"path": "t.csv"}),
        "reference without output": _plan(table, _KEEP, **{"return": {"mode": "reference"}}),
        "unknown key": _plan(table, _KEEP, extra=1),
        "bad condition": _plan(table, where({"field": "k", "like": 1})),
        "bad expression": _plan(table, [{"op": "derive", "field": "x", "expr": {"power": [1, 2]}}]),
        "no field": _plan(table, [_fields("nope")]),
        "limit too high": _plan(table, _KEEP, limits={"max_rows": 10**12}),
        "rows over budget": _plan(table, where({"field": "k", "gt": 0}), limits={"max_rows": 2}),
        "items over budget": _plan(table, where({"field": "k", "gt": 0}), limits={"max_items": 11}),
        "key types": _plan({**table, "m": {"inline": [{"k": "1"}]}}, [{"op": "join", "left": "n", "right": "m", "on": [["k", "k"]]}]),
        "path not found": _plan(tree, [{"op": "delete", "path": "a.c"}]),
        "step on a tree": _plan(tree, _KEEP),
        "assertion": _plan(table, _KEEP, **{"assert": [{"type": "row_count", "eq": 4}]}),
        "schema": _plan(table, _KEEP, schema={"type": "array", "items": {"properties": {"k": {"maximum": 2}}}}),
    }
    engine = Engine(spark, root=str(to))
    return _report(spark, [(name, engine.transform(plan).get("error", {}).get("code")) for name, plan in cases.items()], "case_name string, error string")


@code("validate_assertions", "select * from (values ('field_exists', 'o_orderkey', true), ('field_exists', 'o_nothing', false), ('type', 'o_orderkey', true), ('type', 'o_orderstatus', true), ('type', 'o_totalprice', false)) as a(kind, field, passed) union all select 'not_null', 'o_custkey', count(*) = count(o_custkey) from orders union all select 'unique', 'o_orderkey', count(*) = count(distinct o_orderkey) from orders union all select 'unique', 'o_custkey', count(*) = count(distinct o_custkey) from orders")
def _assertions(spark, sf_dir):
    wanted = [{"type": "field_exists", "field": "o_orderkey"}, {"type": "field_exists", "field": "o_nothing"}, {"type": "type", "field": "o_orderkey", "is": "integer"}, {"type": "type", "field": "o_orderstatus", "is": "string"}, {"type": "type", "field": "o_totalprice", "is": "string"}, {"type": "not_null", "field": "o_custkey"}, {"type": "unique", "fields": ["o_orderkey"]}, {"type": "unique", "fields": ["o_custkey"]}]
    found = _done(_engine(spark, sf_dir).validate({"path": "orders.parquet"}, assertions=wanted))["assertions"]
    return _report(spark, [(w["type"], w.get("field") or w["fields"][0], a["passed"]) for w, a in zip(wanted, found, strict=True)], "kind string, field string, passed boolean")


@code("validate_schema_verdict", "select count(*) = 0 as valid, least(count(*), 20) as listed, count(*) > 20 as truncated from part where p_size % 3 = 0")
def _verdict(spark, sf_dir):
    found = checks.validate_schema("table", parquet(spark, f"{sf_dir}/part.parquet"), None, {"type": "object", "properties": {"p_size": {"not": {"multipleOf": 3}}}})
    return _report(spark, [(found["valid"], len(found["failures"]), found["failures_truncated"])], "valid boolean, listed long, truncated boolean")


_RIGHT = "select o_orderkey, case when o_totalprice > 300000 then 'X' else o_orderstatus end as o_orderstatus from orders where o_totalprice >= 30000"


@code("diff_report", f"with r as ({_RIGHT}) select (select count(*) from orders) as left_rows, (select count(*) from r) as right_rows, 0 as added_rows, (select count(*) from orders where o_totalprice < 30000) as removed_rows, (select count(*) from orders where o_totalprice > 300000 and o_orderstatus <> 'X') as changed_rows, false as identical")
def _diff(spark, sf_dir):
    left, right = _versions(spark, sf_dir)
    found = _done(Engine(spark, enforce_limits=False).diff({"path": left}, {"path": right}, ["o_orderkey"]))
    names = ["left_rows", "right_rows", "added_rows", "removed_rows", "changed_rows"]
    return _report(spark, [(*[found[n] for n in names], found["identical"])], ", ".join(f"{n} long" for n in names) + ", identical boolean")


def _versions(spark, sf_dir) -> tuple[str, str]:
    """The orders' keys and states, and a later version of them, as Parquet folders."""
    to = folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.select("o_orderkey", "o_orderstatus").write.parquet(f"{to}/left.parquet")
    later = orders.where("o_totalprice >= 30000").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 300_000, "X").otherwise(F.col("o_orderstatus")))
    later.select("o_orderkey", "o_orderstatus").write.parquet(f"{to}/right.parquet")
    return tuple(f"{to}/{side}.parquet".removeprefix("file://") for side in ("left", "right"))


@code("diff_kinds_schemas", "select * from (values ('schema', 'added', 'r_regionkey,r_name', 'not_comparable'), ('schema', 'removed', 'n_nationkey,n_name,n_regionkey', 'not_comparable'), ('kind', 'left', 'table', 'not_comparable'), ('kind', 'right', 'tree', 'not_comparable')) as d(part, side, what, rows)")
def _schemas(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    tables = _done(engine.diff({"path": "nation.parquet"}, {"path": "region.parquet"}))
    kinds = _done(engine.diff({"path": "nation.parquet"}, {"inline": {"a": 1}, "kind": "tree"}))
    rows = [("schema", s, ",".join(tables["schema"][s]), tables["row_comparison"]) for s in ("added", "removed")]
    rows += [("kind", s, kinds["kind_change"][s], kinds["row_comparison"]) for s in ("left", "right")]
    return _report(spark, rows, "part string, side string, what string, rows string")


@code("diff_trees", "select * from (values ('$.a', 'changed'), ('$.b', 'removed'), ('$.c[1]', 'added'), ('$.d.e', 'type')) as d(path, change)")
def _trees(spark, sf_dir):
    left, right = {"a": 1, "b": [1], "c": [0], "d": {"e": 1, "f": 2}}, {"a": 2, "c": [0, 1], "d": {"e": "1", "f": 2}}
    found = _done(Engine(spark).diff({"inline": left, "kind": "tree"}, {"inline": right, "kind": "tree"}))
    return _report(spark, [(c["path"], c["change"]) for c in found["changes"]], "path string, change string")


@code("tree_unflatten", "select event_id, cast(json_extract_string(props, '$.k') as varchar) as k, '7' as deep from events")
def _unflatten(spark, sf_dir):
    doc = trees.edited_column(F.col("props"), [{"op": "set", "path": "in_side_deep", "value": 7, "create": True}, {"op": "unflatten"}])
    at = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", doc.alias("doc"))
    return at.select("event_id", F.get_json_object("doc", "$.k").alias("k"), F.get_json_object("doc", "$.in.side.deep").alias("deep"))


@code("tree_changes", "select * from (values ('set', 'added', ''), ('set', 'removed', ''), ('delete', 'added', ''), ('delete', 'removed', '/gone'), ('merge', 'added', '/z'), ('merge', 'removed', '')) as c(op, kind, paths)")
def _changes(spark, sf_dir):
    """What each step of a tree plan adds and removes, as JSON pointers."""
    steps = [{"op": "set", "path": "a.b", "value": 2}, {"op": "delete", "path": "gone"}, {"op": "merge", "value": {"z": 1}}]
    found = _done(Engine(spark).transform(_plan({"t": {"inline": {"a": {"b": 1}, "gone": True}, "kind": "tree"}}, steps)))
    rows = [(s["op"], kind, ",".join(s[kind])) for s in found["execution_effects"]["steps"] for kind in ("added", "removed")]
    return _report(spark, rows, "op string, kind string, paths string")


@code("inspect_table", "select 'c_custkey' as name, 'integer' as type, count(*) as rows, count(*) - count(c_custkey) as null_count from customer union all select 'c_name', 'string', count(*), count(*) - count(c_name) from customer union all select 'c_nationkey', 'integer', count(*), count(*) - count(c_nationkey) from customer")
def _inspect(spark, sf_dir):
    shape = _done(_engine(spark, sf_dir).inspect({"path": "customer.parquet"}))["shape"]
    kinds = {"int": "integer", "bigint": "integer"}
    rows = [(f["name"], kinds.get(f["type"], f["type"]), shape["rows"], f["null_count"]) for f in shape["fields"] if f["name"] in ("c_custkey", "c_name", "c_nationkey")]
    return _report(spark, rows, "name string, type string, rows long, null_count long")


@code("inspect_sample", "select n_nationkey, n_name from nation order by n_nationkey limit 7")
def _sample(spark, sf_dir):
    found = _done(_engine(spark, sf_dir).inspect({"path": "nation.parquet"}, sample_rows=7))["sample"]
    return _report(spark, [(r["n_nationkey"], r["n_name"]) for r in found], "n_nationkey int, n_name string")


_TREE = {"b": {"rows": [{"x": 1, "y": None}, {"x": 2.5, "z": [1, 2, 3]}]}, "a": [{"k": "v"}], "name": "t"}


@code("inspect_tree", "select * from (values ('/a', 'a[*]', 1, 'k', 'string', 0, 0), ('/b/rows', 'b.rows[*]', 2, 'x', 'mixed', 0, 0), ('/b/rows', 'b.rows[*]', 2, 'y', 'null', 1, 1), ('/b/rows', 'b.rows[*]', 2, 'z', 'array', 1, 0)) as s(path, selector, rows, field, type, missing, nulls)")
def _record_sets(spark, sf_dir):
    """Arrays of objects anywhere in a tree, in order of keys, and the profile of their fields."""
    shape = _done(Engine(spark).inspect({"inline": _TREE, "kind": "tree"}))["shape"]
    rows = [(s["path"], s["selector"], s["rows"], f["path"], f["type"], f["missing"], f["null"]) for s in shape["record_sets"] for f in s["fields"]]
    return _report(spark, rows, "path string, selector string, rows long, field string, type string, missing long, nulls long")


@code("adapt_table", "select 'ready' as status, 'nation' as target, n_nationkey as value_key, n_name as value_name, 'n_regionkey' as dropped from nation")
def _adapt(spark, sf_dir):
    """The draft plan of a target schema, one field mapped by the caller and one found by its folded name, then run."""
    schema = {"type": "object", "properties": {"nation": {"type": "integer"}, "N_NAME": {"type": "string"}}, "required": ["nation", "N_NAME"]}
    found = _done(_engine(spark, sf_dir).inspect({"path": "nation.parquet"}, target_schema=schema, mappings={"nation": "n_nationkey"}))["adaptation"]
    out = _engine(spark, sf_dir).query(found["plan"])
    return out.select(F.lit(found["status"]).alias("status"), F.lit(found["mappings"][0]["target"]).alias("target"), F.col("nation").alias("value_key"), F.col("N_NAME").alias("value_name"), F.lit(",".join(found["dropped"])).alias("dropped"))


@code("adapt_statuses", "select * from (values ('mapping', 'needs_mapping', 'key,n_regionkey', 'extra'), ('ready', 'ready', '', 'extra'), ('composed', 'unsupported', '', '')) as s(case_name, status, unresolved, omitted)")
def _statuses(spark, sf_dir):
    """A required field without a source and one of another type stay unresolved; a composed target is not supported."""
    target = lambda **p: {"type": "object", "properties": {**p, "extra": {"type": "string"}}, "required": list(p)}
    cases = {
        "mapping": target(key={"type": "integer"}, n_name={"type": "string"}, n_regionkey={"type": "string"}),
        "ready": target(n_name={"type": "string"}, n_regionkey={"type": "number"}),
        "composed": {"oneOf": [{"type": "object"}]},
    }
    rows = []
    for name, schema in cases.items():
        a = _done(_engine(spark, sf_dir).inspect({"path": "nation.parquet"}, target_schema=schema))["adaptation"]
        rows.append((name, a["status"], ",".join(u["target"] for u in a.get("unresolved", [])), ",".join(a.get("omitted", []))))
    return _report(spark, rows, "case_name string, status string, unresolved string, omitted string")


@code("shapes_empty", "select cast(0 as bigint) as rows, 'n_nationkey,n_name,n_regionkey' as columns")
def _empty(spark, sf_dir):
    """Flatten and unflatten of an empty nested table keep its fields."""
    out = _engine(spark, sf_dir).query(_plan({"n": {"path": "nation.parquet"}}, [{"op": "limit", "count": 0}, {"op": "unflatten"}, {"op": "flatten"}, {"op": "unflatten"}])).select("n.*")
    return out.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(",".join(f"n_{c}" for c in out.columns)))


@code("join_key_types", "select n_name, c_custkey from customer join nation on c_nationkey = n_nationkey")
def _key_types(spark, sf_dir):
    """Keys of different integer widths join by value."""
    steps = [{"id": "wide", "op": "cast", "source": "n", "fields": {"n_nationkey": "bigint"}}, {"id": "j", "op": "join", "left": "wide", "right": "c", "on": [["n_nationkey", "c_nationkey"]]}, _fields("n_name", "c_custkey")]
    return _engine(spark, sf_dir).query(_plan({"n": {"path": "nation.parquet"}, "c": {"path": "customer.parquet"}}, steps))
