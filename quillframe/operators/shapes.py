"""explode, pivot, unpivot, flatten, unflatten."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import Frame, Key, descriptor, distinct_names, exact, field_of, hidden, quoted
from quillframe.functions.kinds import compatible, family, literal, literal_family
from quillframe.operators.groups import aggregate


def explode(frame: Frame, step: dict) -> Frame:
    """One row per element, the element last; rows with a null or empty array go."""
    name = step["field"]
    if not isinstance(exact(frame, name), T.ArrayType):
        raise PlanError("E_TYPE_MISMATCH", f"field {name!r} is not an array", {"field": name})
    place, value = hidden(), hidden()
    others = [quoted(c) for c in frame.columns if c != name]
    df = frame.df.select(*others, F.posexplode(quoted(name)).alias(place, value), *frame.carried())
    columns = [c for c in frame.columns if c != name]
    df = df.select(*[quoted(c) for c in columns], F.col(value).alias(name), *frame.carried(), F.col(place))
    return replace(frame, df=df, order=(*frame.order, Key(place)))


def pivot(frame: Frame, step: dict) -> Frame:
    """Conditional aggregates over the listed values: a missing cell counts 0 and is null otherwise."""
    field, kind = field_of(frame, step["field"])
    value, _ = field_of(frame, step["value"])
    op, names, cells = step.get("aggregate", "sum"), [], []
    for v in step["values"]:
        if not (v is not None and compatible(family(kind), literal_family(v))):
            raise PlanError("E_TYPE_MISMATCH", "a pivot value is of another type than its field", {"value": str(v)})
        text = ("true" if v else "false") if isinstance(v, bool) else str(v)
        names.append((step.get("aliases") or {}).get(text, text))
        hit = field == literal(v)
        cells.append(F.count_if(hit) if op == "count" else aggregate(frame, op, F.when(hit, value), step["value"]))
    by = [descriptor(b) for b in step.get("by") or []]
    distinct_names([*[n for _, n in by], *names])
    return _grouped(frame, by, [c.alias(n) for c, n in zip(cells, names, strict=True)])


def _grouped(frame: Frame, by: list[tuple[str, str]], aggregates: list[Column]) -> Frame:
    """Group by paths; rows come out by dimension, ascending with nulls last."""
    if not by:
        return Frame(frame.df.agg(*aggregates))
    df = frame.df.groupBy(*[field_of(frame, p)[0].alias(n) for p, n in by]).agg(*aggregates)
    keys = [Key(hidden()) for _ in by]
    return Frame(df.select("*", *[quoted(n).alias(k.name) for (_, n), k in zip(by, keys, strict=True)]), tuple(keys))


def unpivot(frame: Frame, step: dict) -> Frame:
    """One row per row and field, interleaved; values must share a type family."""
    fields = step["fields"]
    kinds = [exact(frame, f) for f in fields]
    keep = step.get("keep")
    keep = [c for c in frame.columns if c not in fields] if keep is None else keep
    for k in keep:
        exact(frame, k)
    name, value, place = step.get("name_field", "field"), step.get("value_field", "value"), hidden()
    distinct_names([*keep, name, value])
    same = len({k.simpleString() for k in kinds}) == 1
    numeric = all(compatible(family(kinds[0]), family(k)) for k in kinds)
    rows = []
    for i, f in enumerate(fields):
        c = quoted(f) if same or numeric else quoted(f).cast("string")
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(f).alias("f"), c.alias("v")))
    item = hidden()
    df = frame.df.select(*[quoted(c) for c in keep], F.explode(F.array(*rows)).alias(item), *frame.carried())
    df = df.select(*[quoted(c) for c in keep], F.col(f"{item}.f").alias(name), F.col(f"{item}.v").alias(value), *frame.carried(), F.col(f"{item}.i").alias(place))
    return replace(frame, df=df, order=(*frame.order, Key(place)))


def escaped(name: str, separator: str) -> str:
    return name.replace("\\", "\\\\").replace(separator, "\\" + separator)


def split_name(name: str, separator: str) -> list[str]:
    parts, now, i = [], "", 0
    while i < len(name):
        if name[i] == "\\" and i + 1 < len(name):
            step = len(separator) if name.startswith(separator, i + 1) else 1
            now += name[i + 1 : i + 1 + step]
            i += 1 + step
        elif name.startswith(separator, i):
            parts.append(now)
            now, i = "", i + len(separator)
        else:
            now += name[i]
            i += 1
    return [*parts, now]


def _leaves(column: Column, kind: T.DataType, path: list[str]):
    if isinstance(kind, T.StructType) and kind.fields:
        for f in kind.fields:
            yield from _leaves(column.getField(f.name), f.dataType, [*path, f.name])
    else:
        yield path, column


def flatten(frame: Frame, step: dict) -> Frame:
    """Struct leaves as columns, by the schema alone; a null struct gives null leaves."""
    sep = step.get("separator", "_")
    leaves = [x for f in frame.schema.fields for x in _leaves(quoted(f.name), f.dataType, [f.name])]
    names = [sep.join(escaped(p, sep) for p in path) for path, _ in leaves]
    plain = [sep.join(path) for path, _ in leaves]
    distinct_names(names)
    out = frame.project([c.alias(n) for (_, c), n in zip(leaves, names, strict=True)])
    again = sorted({p for p in plain if plain.count(p) > 1})
    return out.warn("W_FLATTEN_COLLISION", fields=again) if again else out


def unflatten(frame: Frame, step: dict) -> Frame:
    sep = step.get("separator", "_")
    root: dict = {}
    for c in frame.columns:
        *above, last = split_name(c, sep)
        if not all([*above, last]):
            raise PlanError("E_FIELD_COLLISION", "a name has an empty segment", {"field": c})
        at = root
        for part in above:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise PlanError("E_FIELD_COLLISION", "a name is both a value and an object", {"field": c})
        if last in at:
            raise PlanError("E_FIELD_COLLISION", "two names meet in one place", {"field": c})
        at[last] = quoted(c)
    build = lambda node: F.struct(*[build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node
    return frame.project([build(v).alias(k) for k, v in root.items()])


def checked_separator(sep: str) -> str:
    if not re.fullmatch(r"[^\\]{1,4}", sep):
        raise PlanError("E_PLAN_INVALID", "a separator has one to four characters and no backslash")
    return sep
