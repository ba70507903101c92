"""The closed plan grammar: every object lists its keys, and nothing is coerced.

A shape is a dict of key -> checker; a checker takes a value and returns it or raises ``Bad``. Which code a failure
gets (plan, condition, expression) follows from where it happened.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quillframe.errors import PlanError
from quillframe.functions.kinds import normalised
from quillframe.functions.predicates import COMPARISONS
from quillframe.operators.groups import AGGREGATES

FORMATS = ("json", "jsonl", "csv", "tsv", "yaml", "parquet")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


class Bad(Exception):
    def __init__(self, message: str, code: str = "E_PLAN_INVALID"):
        super().__init__(message)
        self.code = code


Check = Callable[[object], object]


def text(v):
    if not isinstance(v, str) or not v:
        raise Bad("a non-empty string is needed")
    return v


def string(v):
    if not isinstance(v, str):
        raise Bad("a string is needed")
    return v


def ident(v):
    if not isinstance(v, str) or not _IDENT.fullmatch(v):
        raise Bad("an identifier is needed")
    return v


def flag(v):
    if not isinstance(v, bool):
        raise Bad("true or false is needed")
    return v


def anything(v):
    return v


def whole(low: int | None = 0, high: int | None = None) -> Check:
    def check(v):
        if isinstance(v, bool) or not isinstance(v, int) or (low is not None and v < low) or (high is not None and v > high):
            raise Bad("an integer in range is needed")
        return v

    return check


def one_of(*values) -> Check:
    def check(v):
        if v not in values:
            raise Bad(f"one of {', '.join(map(str, values))} is needed")
        return v

    return check


def many(item: Check, low: int = 0, high: int | None = None) -> Check:
    def check(v):
        if not isinstance(v, list) or len(v) < low or (high is not None and len(v) > high):
            raise Bad(f"a list of {low} to {high or 'any number of'} entries is needed")
        return [item(x) for x in v]

    return check


def table(key: Check, value: Check, low: int = 0) -> Check:
    def check(v):
        if not isinstance(v, dict) or len(v) < low:
            raise Bad("an object is needed")
        return {key(k): value(x) for k, x in v.items()}

    return check


def shape(required: dict[str, Check], optional: dict[str, Check] | None = None, also: Check | None = None) -> Check:
    keys = {**required, **(optional or {})}

    def check(v):
        if not isinstance(v, dict):
            raise Bad("an object is needed")
        extra, missing = sorted(set(v) - set(keys)), sorted(set(required) - set(v))
        if extra or missing:
            raise Bad(f"unknown keys {extra}, missing keys {missing}")
        out = {k: keys[k](x) for k, x in v.items() if not (x is None and k in (optional or {}))}
        return also(out) if also else out

    return check


def _as(code: str, check: Check) -> Check:
    def run(v):
        try:
            return check(v)
        except Bad as e:
            raise Bad(str(e), code) from None

    return run


def condition(v):
    if not isinstance(v, dict):
        raise Bad("a condition is an object")
    groups = [k for k in ("all", "any", "not") if k in v]
    if groups:
        if len(v) != 1:
            raise Bad("a combined condition has no other keys")
        return {groups[0]: condition(v["not"]) if groups[0] == "not" else many(condition, 1)(v[groups[0]])}
    ops = [k for k in v if k != "field"]
    if "field" not in v or len(ops) != 1 or ops[0] not in COMPARISONS:
        raise Bad("a condition is a field and one comparison")
    op, value = ops[0], v[ops[0]]
    if op in ("in", "not_in"):
        many(anything, 1, 10_000)(value)
    elif op in ("contains", "starts_with", "ends_with"):
        string(value)
    elif op in ("is_null", "not_null") and value is not True:
        raise Bad(f"{op} takes true")
    return {"field": text(v["field"]), op: normalised(value)}


def expression(v):
    if not isinstance(v, dict) or len(v) != 1:
        raise Bad("an expression is an object with one key")
    ((op, arg),) = v.items()
    if op == "field":
        return {op: text(arg)}
    if op == "value":
        return {op: normalised(arg)}
    if op in ("add", "subtract", "multiply"):
        return {op: many(expression, 2)(arg)}
    if op == "divide":
        return {op: many(expression, 2, 2)(arg)}
    if op in ("concat", "coalesce"):
        return {op: many(expression, 1)(arg)}
    if op in ("lower", "upper"):
        return {op: expression(arg)}
    if op == "substring":
        many(anything, 2, 3)(arg)
        return {op: [expression(arg[0]), *[whole(None)(x) for x in arg[1:]]]}
    if op == "round":
        if isinstance(arg, list):
            many(anything, 1, 2)(arg)
            return {op: [expression(arg[0]), *[whole(None)(x) for x in arg[1:]]]}
        return {op: expression(arg)}
    raise Bad(f"unknown expression {op!r}")


def aliased(v):
    return v if isinstance(v, str) and v else shape({"field": text}, {"as": text})(v)


def _aggregate(v):
    if v["op"] != "count" and "field" not in v:
        raise Bad("only count goes without a field")
    return v


def _cast(v):
    if ("fields" in v) == ("field" in v or "to" in v) or ("field" in v) != ("to" in v):
        raise Bad("cast takes fields, or field and to")
    return v


def _separator(v):
    if not isinstance(v, str) or not re.fullmatch(r"[^\\]{1,4}", v):
        raise Bad("a separator has one to four characters and no backslash")
    return v


_WHERE, _EXPR = _as("E_CONDITION_INVALID", condition), _as("E_EXPRESSION_INVALID", expression)
_ONE = {"id": ident, "source": text}
_PAIR = many(text, 2, 2)
#: Step grammar: operator -> required keys, optional keys, cross-check.
STEPS: dict[str, Check] = {
    op: shape({"op": text, **required}, {**(_ONE if op != "join" else {"id": ident}), **optional}, also)
    for op, required, optional, also in [
        ("filter", {"where": _WHERE}, {}, None),
        ("select", {"fields": many(aliased, 1)}, {}, None),
        ("drop", {"fields": many(text, 1)}, {}, None),
        ("rename", {"fields": table(text, text, 1)}, {}, None),
        ("sort", {"by": many(lambda v: v if isinstance(v, str) and v else shape({"field": text}, {"direction": one_of("asc", "desc"), "nulls": one_of("first", "last")})(v), 1)}, {}, None),
        ("limit", {"count": whole()}, {"offset": whole()}, None),
        ("dedupe", {"fields": many(text, 1)}, {"keep": one_of("first", "last")}, None),
        ("cast", {}, {"fields": table(text, text, 1), "field": text, "to": text}, _cast),
        ("derive", {"field": text, "expr": _EXPR}, {}, None),
        ("explode", {"field": text}, {}, None),
        ("join", {"left": text, "right": text, "on": many(_PAIR, 1)}, {"type": one_of("inner", "left", "right", "full"), "right_prefix": string}, None),
        ("group", {"aggregates": many(shape({"op": one_of(*AGGREGATES)}, {"field": text, "as": text}, _aggregate), 1)}, {"by": many(aliased)}, None),
        ("pivot", {"field": text, "value": text, "values": many(normalised, 1, 100)}, {"by": many(aliased), "aggregate": one_of("sum", "avg", "min", "max", "count"), "aliases": table(string, text)}, None),
        ("unpivot", {"fields": many(text, 1)}, {"keep": many(text), "name_field": text, "value_field": text}, None),
        ("flatten", {}, {"separator": _separator}, None),
        ("unflatten", {}, {"separator": _separator}, None),
        ("set", {"path": text, "value": anything}, {"create": flag}, None),
        ("delete", {"path": text}, {}, None),
        ("merge", {"value": table(string, anything)}, {"deep": flag}, None),
    ]
}


def step(v):
    if not isinstance(v, dict) or v.get("op") not in STEPS:
        raise Bad(f"unknown operator {v.get('op') if isinstance(v, dict) else v!r}")
    held = STEPS[v["op"]](v)
    return held | {"value": v["value"]} if v["op"] == "set" else held


def source(v):
    if not isinstance(v, dict) or ("path" in v) == ("inline" in v):
        raise Bad("a source has exactly one of path and inline")
    return shape({"path": text} if "path" in v else {"inline": anything}, {"format": one_of(*FORMATS), "select": text, "kind": one_of("tree", "table")})(v)


def _unique(v):
    if ("field" in v) == ("fields" in v):
        raise Bad("unique takes one of field and fields")
    return v


def _bounded(v):
    if not {"eq", "min", "max"} & set(v):
        raise Bad("row_count takes eq, min or max")
    return v


_ASSERTS: dict[str, Check] = {
    "field_exists": shape({"type": text, "field": text}, {"id": text}),
    "not_null": shape({"type": text, "field": text}, {"id": text}),
    "unique": shape({"type": text}, {"id": text, "field": text, "fields": many(text, 1)}, _unique),
    "row_count": shape({"type": text}, {"id": text, "eq": whole(), "min": whole(), "max": whole()}, _bounded),
    "type": shape({"type": text, "field": text, "is": text}, {"id": text}),
}


def assertion(v):
    if not isinstance(v, dict) or v.get("type") not in _ASSERTS:
        raise Bad("unknown assertion", "E_ASSERTION_INVALID")
    return _as("E_ASSERTION_INVALID", _ASSERTS[v["type"]])(v)


_PLAN = shape(
    {"version": one_of("1"), "sources": table(text, source, 1), "steps": many(step, 1, 100)},
    {
        "assert": many(assertion), "schema": table(string, anything), "output": shape({"path": text}, {"format": one_of(*FORMATS), "overwrite": flag}),
        "return": shape({}, {"mode": one_of("auto", "inline", "summary", "reference"), "sample_rows": whole(0, 100), "max_inline_bytes": whole(1, 1 << 20)}),
        "limits": table(string, anything), "dry_run": flag,
    },
)


def checked(check: Check, value, what: str):
    try:
        return check(value)
    except Bad as e:
        raise PlanError(e.code, f"{what}: {e}") from None


def plan(value) -> dict:
    """A checked copy of a plan; fractions in it are exact decimals from here on."""
    return checked(_PLAN, value, "the plan is invalid")
