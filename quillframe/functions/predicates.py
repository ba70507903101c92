"""Conditions: thirteen comparisons and all/any/not, under SQL's three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.errors import PlanError
from quillframe.frame import Frame, field_of
from quillframe.functions.kinds import compatible, family, literal, literal_family

COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "starts_with", "ends_with", "is_null", "not_null")
_ORDERED = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}
_TEXT = {"contains": Column.contains, "starts_with": Column.startswith, "ends_with": Column.endswith}


def _checked(name: str, kind: str, value) -> None:
    if value is not None:
        if not compatible(kind, literal_family(value)):
            raise PlanError("E_TYPE_MISMATCH", f"field {name!r} is {kind}, the value is {literal_family(value)}", {"field": name})


def condition(frame: Frame, spec: dict) -> Column:
    if "all" in spec:
        return reduce(lambda a, b: a & b, [condition(frame, s) for s in spec["all"]])
    if "any" in spec:
        return reduce(lambda a, b: a | b, [condition(frame, s) for s in spec["any"]])
    if "not" in spec:
        return ~condition(frame, spec["not"])
    name = spec["field"]
    column, kind = field_of(frame, name)
    op = next(c for c in COMPARISONS if c in spec)
    value, kind = spec[op], family(kind)
    if op == "is_null":
        return column.isNull()
    if op == "not_null":
        return column.isNotNull()
    if op in _TEXT:
        if kind != "string":
            raise PlanError("E_TYPE_MISMATCH", f"{op} needs a string field", {"field": name})
        return _TEXT[op](column, F.lit(value))
    if op in ("in", "not_in"):
        for v in value:
            _checked(name, kind, v)
        inside = column.isin(*[literal(v) for v in value])
        return inside if op == "in" else ~inside
    _checked(name, kind, value)
    if value is None:
        return {"eq": column.isNull(), "ne": column.isNotNull()}.get(op, F.lit(None).cast("boolean"))
    return _ORDERED[op](column, literal(value))
