"""Assertions, and JSON Schema compiled to Spark where it says something about columns.

Single-row figures of all assertions come from one aggregate; each uniqueness check adds one grouping.
"""

from __future__ import annotations

import itertools
import json
import re
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import Frame, exact, quoted
from quillframe.functions.kinds import family

_ALIASES = {"varchar": "string", "text": "string", "int64": "bigint", "integer": "bigint", "float64": "double", "timestamp": "timestamp_ntz"}


def _is_type(kind: T.DataType, wanted: str) -> bool:
    w, name = wanted.lower(), kind.simpleString().lower()
    if w == "number":
        return family(kind) in ("decimal", "number")
    return w in (name, name.split("(")[0], family(kind)) or _ALIASES.get(w) in (name, name.split("(")[0])


def metrics(frame: Frame, assertions: list[dict]) -> DataFrame:
    """One row: ``rows`` and ``null_rows_<i>`` of each not_null assertion."""
    columns = [F.count(F.lit(1)).alias("rows")]
    for i, a in enumerate(assertions):
        if a["type"] == "not_null" and a["field"] in frame.columns:
            columns.append(F.count_if(quoted(a["field"]).isNull()).alias(f"null_rows_{i}"))
    return frame.df.agg(*columns)


def duplicate_groups(frame: Frame, fields: list[str]) -> DataFrame:
    """One row: groups of two rows or more with equal fields; nulls are equal."""
    for f in fields:
        exact(frame, f)
    return frame.df.groupBy(*[quoted(f) for f in fields]).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))


def _bounds(a: dict, n: int) -> bool:
    return (a.get("eq") is None or n == a["eq"]) and (a.get("min") is None or n >= a["min"]) and (a.get("max") is None or n <= a["max"])


def on_table(frame: Frame, assertions: list[dict]) -> list[dict]:
    row = metrics(frame, assertions).first() if any(a["type"] in ("not_null", "row_count") for a in assertions) else None
    out = []
    for i, a in enumerate(assertions):
        kind, found = a["type"], {}
        if kind == "field_exists":
            passed = a["field"] in frame.columns
        elif kind == "not_null":
            there = a["field"] in frame.columns
            found = {"null_rows": row[f"null_rows_{i}"]} if there else {"missing": True}
            passed = there and not found["null_rows"]
        elif kind == "unique":
            found = {"duplicate_groups": duplicate_groups(frame, a.get("fields") or [a["field"]]).first()[0]}
            passed = not found["duplicate_groups"]
        elif kind == "row_count":
            found = {"rows": row["rows"]}
            passed = _bounds(a, row["rows"])
        else:
            there = a["field"] in frame.columns
            found = {"actual": exact(frame, a["field"]).simpleString()} if there else {"missing": True}
            passed = there and _is_type(exact(frame, a["field"]), a["is"])
        out.append({"type": kind, **({"id": a["id"]} if "id" in a else {}), "passed": passed, **found})
    return out


def on_tree(value, assertions: list[dict]) -> list[dict]:
    out = []
    for a in assertions:
        kind = a["type"]
        if kind in ("unique", "type"):
            raise PlanError("E_ASSERTION_INVALID", f"{kind} does not apply to a tree")
        if kind == "row_count":
            n = len(value) if isinstance(value, list) else 1
            out.append({"type": kind, "passed": _bounds(a, n), "rows": n})
        else:
            there = isinstance(value, dict) and a["field"] in value
            out.append({"type": kind, "passed": there and (kind == "field_exists" or value[a["field"]] is not None)})
        if "id" in a:
            out[-1]["id"] = a["id"]
    return out


# ---------------------------------------------------------------- JSON Schema

_KNOWN = {
    "type", "const", "enum", "required", "properties", "additionalProperties", "items", "prefixItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "allOf", "anyOf", "oneOf", "not", "$ref",
    "if", "then", "else", "patternProperties", "propertyNames", "contains", "minContains", "maxContains", "dependentRequired", "dependentSchemas", "unevaluatedProperties", "unevaluatedItems",
}
#: Keywords of an array of rows that need no row beside another, or only counts.
_BY_ROW = {"type", "items", "minItems", "maxItems", "uniqueItems"}
_NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment", "format", "deprecated", "readOnly", "writeOnly"}


def checked_schema(schema, at: str = "#") -> None:
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise PlanError("E_SCHEMA_INVALID", f"{at} is not a schema")
    other = sorted(set(schema) - _KNOWN - _NOTES)
    if other:
        raise PlanError("E_SCHEMA_INVALID", f"{at} uses keywords that are not supported", {"keywords": other})
    types = schema.get("type", [])
    for t in types if isinstance(types, list) else [types]:
        if t not in ("null", "boolean", "integer", "number", "string", "array", "object"):
            raise PlanError("E_SCHEMA_INVALID", f"{at} has an unknown type", {"type": str(t)})
    for k in ("allOf", "anyOf", "oneOf", "prefixItems"):
        for i, s in enumerate(schema.get(k, [])):
            checked_schema(s, f"{at}/{k}/{i}")
    for k in ("not", "items", "additionalProperties", "if", "then", "else", "propertyNames", "contains", "unevaluatedProperties", "unevaluatedItems"):
        if k in schema:
            checked_schema(schema[k], f"{at}/{k}")
    for k in ("properties", "$defs", "definitions", "patternProperties", "dependentSchemas"):
        for n, s in schema.get(k, {}).items():
            checked_schema(s, f"{at}/{k}/{n}")
    for pattern in (*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", {})):
        try:
            re.compile(pattern)
        except (re.error, TypeError) as e:
            raise PlanError("E_SCHEMA_INVALID", f"{at} has a bad pattern: {e}") from None


def _has_type(v, t: str) -> bool:
    if t == "null":
        return v is None
    if t == "boolean":
        return isinstance(v, bool)
    number = isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
    if t == "number":
        return number
    if t == "integer":
        return number and (isinstance(v, int) or (v.is_integer() if isinstance(v, float) else v.is_finite() and v == v.to_integral_value()))
    return isinstance(v, {"string": str, "array": list, "object": dict}[t])


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _dec(x) -> Decimal:
    return x if isinstance(x, Decimal) else Decimal(repr(x)) if isinstance(x, float) else Decimal(x)


def _meets(v, schema, root) -> bool:
    return next(failures(v, schema, root), None) is None


def _target(root, ref: str):
    if not ref.startswith("#"):
        raise PlanError("E_SCHEMA_INVALID", "only local references are supported", {"ref": ref})
    target = root
    for part in [p.replace("~1", "/").replace("~0", "~") for p in ref[1:].split("/") if p]:
        if not (isinstance(target, dict) and part in target):
            raise PlanError("E_SCHEMA_INVALID", "a reference leads nowhere", {"ref": ref})
        target = target[part]
    return target


def _evaluated(v, schema, root) -> set:
    """Properties of an object, or places of an array, that a schema which ``v`` meets has looked at."""
    if not isinstance(schema, dict):
        return set()
    out: set = set()
    if isinstance(v, dict):
        out |= {k for k in v if k in schema.get("properties", {}) or any(re.search(p, k) for p in schema.get("patternProperties", {}))}
        if "additionalProperties" in schema or "unevaluatedProperties" in schema:
            out |= set(v)
    if isinstance(v, list):
        out |= set(range(len(v) if "items" in schema or "unevaluatedItems" in schema else min(len(v), len(schema.get("prefixItems", [])))))
        if "contains" in schema:
            out |= {i for i, x in enumerate(v) if _meets(x, schema["contains"], root)}
    inside = [*schema.get("allOf", []), *schema.get("anyOf", []), *schema.get("oneOf", []), *([_target(root, schema["$ref"])] if "$ref" in schema else [])]
    inside += [s for k, s in schema.get("dependentSchemas", {}).items() if isinstance(v, dict) and k in v]
    if "if" in schema:
        inside += [schema["if"], schema.get("then", True)] if _meets(v, schema["if"], root) else [schema.get("else", True)]
    return out.union(*(_evaluated(v, s, root) for s in inside if _meets(v, s, root)))


def failures(v, schema, root=None, path: str = "$"):
    """(path, keyword, message) of each failure, in keyword order."""
    root = schema if root is None else root
    if schema is True:
        return
    if schema is False:
        yield path, "false", "nothing is allowed here"
        return
    if "$ref" in schema:
        yield from failures(v, _target(root, schema["$ref"]), root, path)
    types = schema.get("type")
    if types is not None:
        types = types if isinstance(types, list) else [types]
        if not any(_has_type(v, t) for t in types):
            yield path, "type", f"is not of type {', '.join(types)}"
    if "const" in schema and not _same(v, schema["const"]):
        yield path, "const", "is not the constant"
    if "enum" in schema and not any(_same(v, e) for e in schema["enum"]):
        yield path, "enum", "is not one of the listed values"
    if _has_type(v, "number") and v == v:
        d = _dec(v)
        for k, bad in (("minimum", lambda b: d < b), ("maximum", lambda b: d > b), ("exclusiveMinimum", lambda b: d <= b), ("exclusiveMaximum", lambda b: d >= b), ("multipleOf", lambda b: not d.is_finite() or Fraction(d) % Fraction(b))):
            if k in schema and bad(_dec(schema[k])):
                yield path, k, f"fails {k}"
    if isinstance(v, str):
        if len(v) < schema.get("minLength", 0):
            yield path, "minLength", "is too short"
        if len(v) > schema.get("maxLength", len(v)):
            yield path, "maxLength", "is too long"
        if "pattern" in schema and not re.search(schema["pattern"], v):
            yield path, "pattern", "does not match"
    if isinstance(v, list):
        if len(v) < schema.get("minItems", 0):
            yield path, "minItems", "has too few items"
        if len(v) > schema.get("maxItems", len(v)):
            yield path, "maxItems", "has too many items"
        if schema.get("uniqueItems") and any(_same(a, b) for i, a in enumerate(v) for b in v[:i]):
            yield path, "uniqueItems", "has equal items"
        prefix = schema.get("prefixItems", [])
        for i, x in enumerate(v):
            if i < len(prefix):
                yield from failures(x, prefix[i], root, f"{path}[{i}]")
            elif "items" in schema:
                yield from failures(x, schema["items"], root, f"{path}[{i}]")
        if "contains" in schema:
            n = sum(_meets(x, schema["contains"], root) for x in v)
            if n < schema.get("minContains", 1):
                yield path, "contains" if "minContains" not in schema else "minContains", "has too few items of a kind"
            if n > schema.get("maxContains", n):
                yield path, "maxContains", "has too many items of a kind"
    if isinstance(v, dict):
        for k in schema.get("required", []):
            if k not in v:
                yield path, "required", f"{k!r} is missing"
        if len(v) < schema.get("minProperties", 0):
            yield path, "minProperties", "has too few properties"
        if len(v) > schema.get("maxProperties", len(v)):
            yield path, "maxProperties", "has too many properties"
        known = schema.get("properties", {})
        for k, x in v.items():
            like = [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            for s in [*([known[k]] if k in known else []), *like]:
                yield from failures(x, s, root, f"{path}.{k}")
            if "propertyNames" in schema and not _meets(k, schema["propertyNames"], root):
                yield path, "propertyNames", f"{k!r} is not a valid name"
            if k not in known and not like and "additionalProperties" in schema:
                extra = schema["additionalProperties"]
                if extra is False:
                    yield path, "additionalProperties", f"{k!r} is not allowed"
                else:
                    yield from failures(x, extra, root, f"{path}.{k}")
        for k, needed in schema.get("dependentRequired", {}).items():
            for other in needed if k in v else []:
                if other not in v:
                    yield path, "dependentRequired", f"{other!r} is missing beside {k!r}"
        for k, s in schema.get("dependentSchemas", {}).items():
            if k in v:
                yield from failures(v, s, root, path)
    for s in schema.get("allOf", []):
        yield from failures(v, s, root, path)
    if "anyOf" in schema and not any(_meets(v, s, root) for s in schema["anyOf"]):
        yield path, "anyOf", "meets none of the alternatives"
    if "oneOf" in schema and sum(_meets(v, s, root) for s in schema["oneOf"]) != 1:
        yield path, "oneOf", "does not meet exactly one alternative"
    if "not" in schema and _meets(v, schema["not"], root):
        yield path, "not", "meets what it must not"
    if "if" in schema:
        yield from failures(v, schema.get("then" if _meets(v, schema["if"], root) else "else", True), root, path)
    for keyword, kind in (("unevaluatedProperties", dict), ("unevaluatedItems", list)):
        if keyword in schema and isinstance(v, kind):
            seen = _evaluated(v, {k: s for k, s in schema.items() if k != keyword}, root)
            for k in (k for k in (v if kind is dict else range(len(v))) if k not in seen):
                if not _meets(v[k], schema[keyword], root):
                    yield path, keyword, f"{k!r} is not allowed"


def _json_value(v):
    import base64
    import datetime as dt

    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return {"base64": base64.b64encode(bytes(v)).decode()}
    if hasattr(v, "asDict"):
        return {k: _json_value(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [_json_value(x) for x in v]
    if isinstance(v, dict):
        return {k: _json_value(x) for k, x in v.items()}
    return v


def _plain(v, kind: T.DataType):
    """A value from Arrow in the form of JSON; maps come as pairs."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(v[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_plain(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {k: _plain(x, kind.valueType) for k, x in v}
    return _json_value(v)


def suspects(frame: Frame, schema) -> DataFrame:
    """The rows that a compiled form of the schema does not clear; all rows where no such form exists."""
    met = compiled(frame, schema)
    return frame.df if met is None else frame.df.where(~F.coalesce(met, F.lit(False)))


def row_failures(frame: Frame, schema) -> DataFrame:
    """``row_key..., path, keyword, message`` for every failing row. Rows that the compiled schema clears never leave
    generated code; the others are judged in Arrow batches on the executors."""
    checked_schema(schema)
    text = json.dumps(schema, default=str)
    names, keys = frame.columns, [k.name for k in frame.order]
    df = suspects(frame, schema).select(*[quoted(c) for c in names], *keys)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], *[T.StructField(n, T.StringType()) for n in ("path", "keyword", "message")]])

    def judge(batches):
        import pyarrow as pa

        spec = json.loads(text, parse_float=Decimal)
        for batch in batches:
            columns = [[_plain(x, kinds[n]) for x in batch.column(i).to_pylist()] for i, n in enumerate(names)]
            at, told = [], []
            for row in range(batch.num_rows):
                for found in failures({n: c[row] for n, c in zip(names, columns, strict=True)}, spec):
                    at.append(row)
                    told.append(found)
            own = [batch.column(len(names) + i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([t[i] for t in told], pa.string()) for i in range(3)]], names=out.names)

    return df.mapInArrow(judge, out)


def _before(frame: Frame, row) -> Column:
    """Whether a row comes before the one with these order keys."""
    out = F.lit(False)
    kinds = {f.name: f.dataType for f in frame.df.schema.fields}
    for k in reversed(frame.order):
        c, v = F.col(k.name), row[k.name]
        if v is None:
            less, equal = (c.isNotNull() if k.nulls_last else F.lit(False)), c.isNull()
        else:
            x = F.lit(v).cast(kinds[k.name])
            less, equal = F.when(c.isNull(), F.lit(not k.nulls_last)).otherwise(c < x if k.ascending else c > x), c.eqNullSafe(x)
        out = less | (equal & out)
    return out


def _of_rows(frame: Frame, schema, most: int) -> list[dict]:
    """The first ``most`` failures in row order, each with its row's place from 0."""
    bad = row_failures(frame, schema)
    if not frame.order:
        return [{"row": None, "path": r["path"], "keyword": r["keyword"], "message": r["message"]} for r in bad.limit(most).collect()]
    top = bad.orderBy(*frame.keys()).limit(most).collect()
    keys = [k.name for k in frame.order]
    rows = {tuple(r[k] for k in keys): r for r in top}
    counted = frame.df.agg(*[F.count_if(_before(frame, r)).alias(f"p{i}") for i, r in enumerate(rows.values())]).first() if rows else []
    places = dict(zip(rows, counted, strict=True))
    return [{"row": places[tuple(r[k] for k in keys)], "path": r["path"], "keyword": r["keyword"], "message": r["message"]} for r in top]


def _of_array(frame: Frame, schema: dict, most: int) -> list[dict]:
    """A table against the schema of an array: items row by row, sizes and equal items by aggregates. Keywords that say
    something else about the array as a whole need it in one place, at most ``WHOLE_ROWS`` rows."""
    if set(schema) - _BY_ROW - _NOTES:
        rows = frame.sorted.limit(WHOLE_ROWS + 1).collect()
        if len(rows) > WHOLE_ROWS:
            raise PlanError("E_ROW_LIMIT", "the schema speaks of the array as a whole, which has too many rows", {"maximum": WHOLE_ROWS})
        spec = json.loads(json.dumps(schema, default=str), parse_float=Decimal)
        return [{"row": None, "path": p, "keyword": k, "message": m} for p, k, m in itertools.islice(failures([_json_value(r) for r in rows], spec), most)]
    out = []
    if {"minItems", "maxItems"} & set(schema):
        n = frame.df.count()
        out += [{"row": None, "path": "$", "keyword": k, "message": f"has too {w} items"} for k, w, bad in (("minItems", "few", n < schema.get("minItems", n)), ("maxItems", "many", n > schema.get("maxItems", n))) if bad]
    if schema.get("uniqueItems") and frame.columns:
        if frame.df.groupBy(*[quoted(c) for c in frame.columns]).count().where("count > 1").limit(1).count():
            out.append({"row": None, "path": "$", "keyword": "uniqueItems", "message": "has equal items"})
    if "items" in schema:
        rooted = schema["items"] if not isinstance(schema["items"], dict) else {**{k: schema[k] for k in ("$defs", "definitions") if k in schema}, **schema["items"]}
        out += [f | {"path": f"$[{f['row']}]{f['path'][1:]}"} for f in _of_rows(frame, rooted, most)]
    return out[:most]


#: Rows of an array that may be looked at as one value.
WHOLE_ROWS = 100_000


def validate_schema(kind: str, frame: Frame | None, value, schema, most: int = 20) -> dict:
    checked_schema(schema)
    if kind == "tree":
        spec = json.loads(json.dumps(schema, default=str), parse_float=Decimal)
        found = [{"row": None, "path": p, "keyword": k, "message": m} for p, k, m in itertools.islice(failures(value, spec), most + 1)]
    elif isinstance(schema, dict) and schema.get("type") == "array":
        found = _of_array(frame, schema, most + 1)
    else:
        found = _of_rows(frame, schema, most + 1)
    return {"valid": not found, "failures": found[:most], "failures_truncated": len(found) > most}


def _column_test(c: Column, kind: str, keyword: str, x) -> Column | None:
    """A test of a column that is not null, or None where it has no form that agrees with ``failures`` exactly."""
    numeric = kind in ("integer", "decimal", "number")
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    if keyword in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") and number:
        bound = F.lit(Decimal(repr(x))) if kind == "decimal" else F.lit(x)
        return {"minimum": c >= bound, "maximum": c <= bound, "exclusiveMinimum": c > bound, "exclusiveMaximum": c < bound}[keyword] if numeric else F.lit(True)
    if keyword in ("minLength", "maxLength"):
        return (F.length(c) >= x if keyword == "minLength" else F.length(c) <= x) if kind == "string" else F.lit(True) if numeric or kind == "boolean" else None
    if keyword in ("enum", "const"):
        own = {"string": str, "integer": int, "boolean": bool}.get(kind)
        given = [v for v in (x if keyword == "enum" else [x]) if v is not None]
        return c.isin(given) if own and all(type(v) is own for v in given) else None
    if keyword == "multipleOf":
        return (c % x == 0) if kind == "integer" and type(x) is int and x > 0 else F.lit(True) if kind in ("string", "boolean") else None
    return None


def compiled(frame: Frame, schema) -> Column | None:
    """A boolean column that is true only for rows that meet the schema, or None where it uses more than scalar tests of
    columns. What the column does not clear is left to ``failures``."""
    if not isinstance(schema, dict) or set(schema) - {"type", "required", "properties"} - _NOTES:
        return None
    types = schema.get("type", "object")
    if "object" not in (types if isinstance(types, list) else [types]):
        return None
    met = F.lit(all(name in frame.columns for name in schema.get("required", [])))
    fitting = {"integer": ("integer", "number"), "decimal": ("number",), "number": ("number",), "string": ("string",), "boolean": ("boolean",)}
    for name, s in schema.get("properties", {}).items():
        if name not in frame.columns or s is True:
            continue
        if not isinstance(s, dict):
            return None
        c, kind = quoted(name), family(exact(frame, name))
        types = s.get("type", ["null", *fitting.get(kind, [])])
        types = [types] if isinstance(types, str) else types
        fits = any(t in fitting.get(kind, ()) for t in types)
        if not fits and "integer" in types and kind in ("decimal", "number"):
            good = c == F.floor(c)
        else:
            good = F.lit(fits)
        for k, x in s.items():
            if k == "type" or k in _NOTES:
                continue
            test = _column_test(c, kind, k, x)
            if test is None:
                return None
            good = good & test
        empty = "null" in types and all(None in x if k == "enum" else x is None if k == "const" else True for k, x in s.items())
        met = met & F.when(c.isNull(), F.lit(empty)).otherwise(good)
    return met
