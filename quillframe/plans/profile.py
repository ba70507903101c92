"""Shapes, samples and record sets of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.frame import Frame, quoted
from quillframe.sources.trees import pointer
from quillframe.sources.values import Kind, public

FIELD_CAP, SET_CAP, DEPTH_CAP, CHUNK = 1000, 32, 8, 1000


def _items(c: Column, kind: T.DataType) -> Column:
    """How many values a column's value holds, itself included; a null is one."""
    if isinstance(kind, T.StructType):
        inner = [_items(c.getField(f.name), f.dataType) for f in kind.fields]
    elif isinstance(kind, T.ArrayType):
        flat = not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))
        inner = [F.size(c) if flat else F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _items(x, kind.elementType))]
    elif isinstance(kind, T.MapType):
        inner = [_items(F.map_values(c), T.ArrayType(kind.valueType)) - 1]
    else:
        return F.lit(1).cast("long")
    return F.when(c.isNull(), 1).otherwise(sum(inner, F.lit(1).cast("long")))


def item_figures(frame: Frame) -> list[Column]:
    """What has to be summed to know a table's items beside its row count: nothing if no column is nested."""
    kinds = [(c, frame.df.schema[c].dataType) for c in frame.columns]
    nested = [(c, k) for c, k in kinds if isinstance(k, (T.StructType, T.ArrayType, T.MapType))]
    return [F.sum(sum((_items(quoted(c), k) for c, k in nested), F.lit(0).cast("long")) - len(nested)).alias("items")] if nested else []


def table_items(frame: Frame, figures: dict) -> int:
    """Rows, their cells and what is nested in those; the columns of a table without rows."""
    width = len(frame.columns)
    return figures["n"] * (width + 1) + (figures.get("items") or 0) if figures["n"] else width


def null_counts(frame: Frame) -> DataFrame:
    """One row: ``rows`` and ``nulls_<column>``, in one scan that reads validity only."""
    return frame.df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(quoted(c).isNull()).alias(f"nulls_{c}") for c in frame.columns])


def table_shape(frame: Frame, quality: bool = True) -> dict:
    fields = frame.schema.fields
    counts, rows = {}, None
    for i in range(0, max(len(fields), 1), CHUNK):
        part = fields[i : i + CHUNK]
        row = frame.df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(quoted(f.name).isNull()).alias(f"n{j}") for j, f in enumerate(part)] if quality else []).first()
        rows = row["rows"]
        if quality:
            counts |= {f.name: row[f"n{j}"] for j, f in enumerate(part)}
    listed = [{"name": f.name, "type": f.dataType.simpleString(), **({"null_count": counts[f.name], "nullable": counts[f.name] > 0} if quality else {})} for f in fields[:FIELD_CAP]]
    return {"kind": "table", "rows": rows, "columns": len(fields), "fields": listed, **({"fields_truncated": True} if len(fields) > FIELD_CAP else {})}


def table_sample(frame: Frame, n: int) -> list[dict]:
    if not n:
        return []
    df = frame.df.orderBy(*frame.keys()) if frame.order else frame.df
    return [{c: public(r[c]) for c in frame.columns} for r in df.limit(n).select(*[quoted(c) for c in frame.columns]).collect()]


def tree_sample(value, depth: int = DEPTH_CAP, width: int = 50):
    if depth == 0 and isinstance(value, (dict, list)):
        return "..."
    if isinstance(value, dict):
        return {k: tree_sample(v, depth - 1, width) for k, v in list(value.items())[:width]}
    if isinstance(value, list):
        return [tree_sample(v, depth - 1, width) for v in value[:width]]
    return public(value)


def _type_name(v) -> str:
    return {"huge": "integer"}.get(name := Kind.of(v).name, name) if not isinstance(v, (dict, list)) else "object" if isinstance(v, dict) else "array"


def field_profile(rows: list[dict]) -> list[dict]:
    """Per path below rows: types (mixed if several), missing and null counts, array lengths."""
    seen: dict[str, dict] = {}

    def note(path, values, parents, depth):
        if len(seen) >= FIELD_CAP or depth > DEPTH_CAP:
            return
        present = [v for v in values if v is not None]
        types = sorted({_type_name(v) for v in present})
        entry = {"path": path, "type": types[0] if len(types) == 1 else "mixed" if types else "null", "types": types, "nullable": len(present) < parents, "missing": parents - len(values), "null": len(values) - len(present)}
        lists = [v for v in present if isinstance(v, list)]
        if lists:
            entry |= {"min_length": min(map(len, lists)), "max_length": max(map(len, lists))}
        seen[path] = entry
        objects = [v for v in present if isinstance(v, dict)] + [x for v in lists for x in v if isinstance(x, dict)]
        for k in dict.fromkeys(k for o in objects for k in o):
            note(f"{path}.{k}", [o[k] for o in objects if k in o], len(objects), depth + 1)

    for k in dict.fromkeys(k for r in rows for k in r):
        note(k, [r[k] for r in rows if k in r], len(rows), 1)
    return list(seen.values())


def record_sets(value) -> tuple[list[dict], bool]:
    """Arrays of objects anywhere in a tree, in sorted order of keys."""
    found: list[dict] = []
    over = False

    def walk(v, path, selector):
        nonlocal over
        if isinstance(v, list):
            if v and all(isinstance(x, dict) for x in v):
                if len(found) >= SET_CAP:
                    over = True
                    return
                found.append({"path": pointer(path), "selector": f"{selector}[*]", "rows": len(v), "fields": field_profile(v)})
            return
        if isinstance(v, dict):
            for k in sorted(v):
                walk(v[k], [*path, k], f"{selector}.{k}" if selector else k)

    walk(value, [], "")
    return found, over


def tree_shape(value) -> dict:
    sets, over = record_sets(value)
    top = sorted(value)[:FIELD_CAP] if isinstance(value, dict) else []
    return {"kind": "tree", "type": _type_name(value), **({"length": len(value)} if isinstance(value, (dict, list)) else {}), "top_level_fields": top, "record_sets": sets, "record_sets_truncated": over}
