"""Differences of two tables or two trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import Frame, exact, quoted
from quillframe.sources.values import public

SCAN_CAP = 10_000


def schema_changes(left: Frame, right: Frame) -> dict:
    a, b = ({f.name: f.dataType.simpleString() for f in x.schema.fields} for x in (left, right))
    return {"added": [n for n in b if n not in a], "removed": [n for n in a if n not in b], "type_changed": [{"field": n, "left": a[n], "right": b[n]} for n in a if n in b and a[n] != b[n]]}


def _comparable(column, kind: T.DataType):
    return F.to_json(column) if isinstance(kind, (T.MapType, T.VariantType)) else column


def keyed(left: Frame, right: Frame, keys: list[str]) -> DataFrame:
    """Key columns and ``state``: added, removed or changed. Null keys equal each other."""
    for k in keys:
        exact(left, k)
        exact(right, k)
    rest = [c for c in left.columns if c not in keys]
    pack = lambda f, tag: f.df.select(*[quoted(k).alias(f"{tag}{i}") for i, k in enumerate(keys)], F.struct(F.lit(1).alias("__qf_1"), *[_comparable(quoted(c), exact(left, c)).alias(c) for c in rest]).alias(f"{tag}row"))
    l, r = pack(left, "l"), pack(right, "r")  # noqa: E741
    met = reduce(lambda a, b: a & b, [l[f"l{i}"].eqNullSafe(r[f"r{i}"]) for i in range(len(keys))])
    state = F.when(F.col("lrow").isNull(), "added").when(F.col("rrow").isNull(), "removed").when(~F.col("lrow").eqNullSafe(F.col("rrow")), "changed")
    joined = l.join(r, met, "full_outer").withColumn("state", state).where("state is not null")
    return joined.select(*[F.when(F.col("lrow").isNull(), F.col(f"r{i}")).otherwise(F.col(f"l{i}")).alias(k) for i, k in enumerate(keys)], "state")


def unkeyed(left: Frame, right: Frame) -> DataFrame:
    """Rows with ``surplus``: how many more times (fewer, if negative) the right side has them. One shuffle, and equal
    rows are counted before it."""
    names = left.columns
    side = lambda f, n: f.df.select(*[_comparable(quoted(c), exact(left, c)).alias(c) for c in names], F.lit(n).alias("__qf_n"))
    both = side(left, -1).unionByName(side(right, 1))
    return both.groupBy(*[quoted(c) for c in names]).agg(F.sum("__qf_n").alias("surplus")).where("surplus <> 0")


def tables(left: Frame, right: Frame, keys: list[str] | None, sample: int) -> dict:
    schema = schema_changes(left, right)
    counts = left.df.agg(F.count(F.lit(1)).alias("n")).union(right.df.agg(F.count(F.lit(1)).alias("n"))).collect()
    out = {"left_rows": counts[0][0], "right_rows": counts[1][0], "schema": schema}
    if any(schema.values()):
        return {"identical": False, **out, "row_comparison": "not_comparable", "sample": []}
    if keys:
        for side, f in (("left", left), ("right", right)):
            again = f.df.groupBy(*[quoted(k) for k in keys if exact(f, k) is not None]).count().where("count > 1").limit(1).count()
            if again:
                raise PlanError("E_DIFF_KEY_NOT_UNIQUE", f"the keys are not unique on the {side}", {"side": side})
        found = keyed(left, right, keys)
        n = {r["state"]: r["count"] for r in found.groupBy("state").count().collect()}
        rows = [{"change": r["state"], "key": {k: public(r[k]) for k in keys}} for r in found.limit(sample).collect()] if sample else []
        out |= {"added_rows": n.get("added", 0), "removed_rows": n.get("removed", 0), "changed_rows": n.get("changed", 0), "sample": rows}
    else:
        found = unkeyed(left, right)
        n = found.agg(F.coalesce(F.sum(F.when(F.col("surplus") > 0, F.col("surplus"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("surplus") < 0, -F.col("surplus"))), F.lit(0))).first()
        rows = [{"change": "added" if r["surplus"] > 0 else "removed", "row": {k: public(r[k]) for k in left.columns}} for r in found.limit(sample).collect()] if sample else []
        out |= {"added_rows": int(n[0]), "removed_rows": int(n[1]), "sample": rows}
    return {"identical": not (out["added_rows"] or out["removed_rows"] or out.get("changed_rows")), **out}


def trees(left, right, sample: int) -> dict:
    """Changes by path like ``$.a[0]``; the walk stops at a cap and then says so."""
    found, scanned = [], 0
    stack = [("$", left, right)]
    truncated = False
    while stack:
        path, a, b = stack.pop()
        scanned += 1
        if scanned > SCAN_CAP:
            truncated = True
            break
        if isinstance(a, dict) and isinstance(b, dict):
            todo = [(f"{path}.{k}", a.get(k), b.get(k), k in a, k in b) for k in [*a, *[k for k in b if k not in a]]]
        elif isinstance(a, list) and isinstance(b, list):
            todo = [(f"{path}[{i}]", a[i] if i < len(a) else None, b[i] if i < len(b) else None, i < len(a), i < len(b)) for i in range(max(len(a), len(b)))]
        else:
            if type(a) is not type(b):
                found.append({"path": path, "change": "type"})
            elif a != b:
                found.append({"path": path, "change": "changed", "left": public(a), "right": public(b)})
            continue
        for p, x, y, l, r in reversed(todo):  # noqa: E741
            if not l or not r:
                found.append({"path": p, "change": "added" if r else "removed"})
            else:
                stack.append((p, x, y))
    out = {"identical": not found and not truncated, "changes": found[:sample], "changes_truncated": len(found) > sample, "scan_truncated": truncated, "change_count": len(found)}
    return out | ({"count_lower_bound": len(found)} if truncated else {})
