"""Edits of one JSON value. The same functions serve a column of documents, see ``edited_column``."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf

from quillframe.errors import PlanError
from quillframe.functions.kinds import normalised
from quillframe.operators.shapes import escaped, split_name
from quillframe.sources.selectors import parsed
from quillframe.sources.values import dumps, parse_json


def _path(path: str) -> list:
    parts = parsed(path)
    if None in parts:
        raise PlanError("E_SELECTOR_TYPE", "an edit's path has no wildcard", {"path": path})
    return parts


def _missing(path: str) -> PlanError:
    return PlanError("E_PATH_NOT_FOUND", f"path {path!r} does not exist", {"path": path})


def _fresh(value):
    """A copy of a JSON value whose objects and arrays may be edited."""
    if isinstance(value, dict):
        return {k: _fresh(v) for k, v in value.items()}
    return [_fresh(v) for v in value] if isinstance(value, list) else value


def _holds(at, part) -> bool:
    if isinstance(part, int):
        return isinstance(at, list) and part < len(at)
    return isinstance(at, dict) and part in at


def _setter(path: str, new, create: bool):
    parts = _path(path)
    if not parts:
        return lambda value: _fresh(new)
    *above, last = parts

    def edit(value):
        at = value
        for p in above:
            if not _holds(at, p):
                if not (create and isinstance(p, str) and isinstance(at, dict)):
                    raise _missing(path)
                at[p] = {}
            at = at[p]
        if not _holds(at, last) and not (create and isinstance(last, str) and isinstance(at, dict)):
            raise _missing(path)
        at[last] = _fresh(new)
        return value

    return edit


def _deleter(path: str):
    parts = _path(path)
    if not parts:
        raise PlanError("E_STEP_INVALID", "the root cannot be deleted")

    def edit(value):
        at = value
        for p in parts[:-1]:
            if not _holds(at, p):
                raise _missing(path)
            at = at[p]
        if not _holds(at, parts[-1]):
            raise _missing(path)
        del at[parts[-1]]
        return value

    return edit


def _merger(other: dict, deep: bool):
    def fold(a, b):
        for k, v in b.items():
            if deep and isinstance(a.get(k), dict) and isinstance(v, dict):
                fold(a[k], v)
            else:
                a[k] = _fresh(v)

    def edit(value):
        if not isinstance(value, dict):
            raise PlanError("E_TYPE_MISMATCH", "merge needs an object")
        fold(value, other)
        return value

    return edit


def flatten(value, sep: str = "_"):
    if not isinstance(value, dict):
        raise PlanError("E_TYPE_MISMATCH", "flatten needs an object")
    out: dict = {}

    def walk(v, path):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                walk(x, [*path, k])
        else:
            name = sep.join(escaped(p, sep) for p in path)
            if name in out:
                raise PlanError("E_FIELD_COLLISION", "two values flatten to one name", {"field": name})
            out[name] = v

    for k, x in value.items():
        walk(x, [k])
    return out


def unflatten(value, sep: str = "_"):
    if not isinstance(value, dict):
        raise PlanError("E_TYPE_MISMATCH", "unflatten needs an object")
    out: dict = {}
    for name, v in value.items():
        *above, last = split_name(name, sep)
        if not all([*above, last]):
            raise PlanError("E_FIELD_COLLISION", "a name has an empty segment", {"field": name})
        at, made = out, []
        for p in above:
            at = at.setdefault(p, {})
            made.append(p)
            if not isinstance(at, dict):
                raise PlanError("E_FIELD_COLLISION", "a name is both a value and an object", {"field": name})
        if last in at:
            raise PlanError("E_FIELD_COLLISION", "two names meet in one place", {"field": name})
        at[last] = v
    return out


def compiled(step: dict):
    """A tree step as a function of a value that it may edit in place; its path is parsed once."""
    op = step["op"]
    if op == "set":
        return _setter(step["path"], normalised(step["value"]), step.get("create", False))
    if op == "delete":
        return _deleter(step["path"])
    if op == "merge":
        return _merger(normalised(step["value"]), step.get("deep", True))
    if op in ("flatten", "unflatten"):
        whole, sep = flatten if op == "flatten" else unflatten, step.get("separator", "_")
        return lambda value: whole(value, sep)
    raise PlanError("E_UNKNOWN_OPERATION", f"{op!r} does not apply to a tree", {"op": op})


def applied(value, step: dict):
    """The value after a step; the one given stays as it is."""
    return compiled(step)(_fresh(value))


def pointer(path: list) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def changes(old, new) -> dict:
    """Added, removed and changed JSON pointers and changes of type; ancestors of a change count as changed."""
    out: dict = {"added": [], "removed": [], "changed": [], "type_changes": []}

    def walk(a, b, path):
        if type(a) is type(b) and a == b:
            return
        out["changed"].append(pointer(path))
        if type(a) is not type(b):
            out["type_changes"].append(pointer(path))
            return
        pairs = (a, b) if isinstance(a, dict) else (dict(enumerate(a)), dict(enumerate(b))) if isinstance(a, list) else None
        if pairs:
            x, y = pairs
            for k in x:
                if k in y:
                    walk(x[k], y[k], [*path, k])
                else:
                    out["removed"].append(pointer([*path, k]))
            out["added"] += [pointer([*path, k]) for k in y if k not in x]

    walk(old, new, [])
    return out


def edited_column(column, steps: list[dict]):
    """A string column of JSON documents with tree steps applied to each, in Arrow batches; null stays null."""
    edits = [compiled(s) for s in steps]
    plain = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode

    @pandas_udf("string")
    def edit(texts: pd.Series) -> pd.Series:
        def one(t):
            value = parse_json(t)
            for e in edits:
                value = e(value)
            try:
                return plain(value)
            except (TypeError, ValueError):  # exact decimals
                return dumps(value)

        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return edit(column)
