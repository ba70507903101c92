"""filter, select, drop, rename, derive, cast, sort, limit, dedupe."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import Frame, Key, descriptor, distinct_names, exact, field_of, hidden, quoted
from quillframe.functions.expressions import expression
from quillframe.functions.predicates import condition

_TARGETS = {
    "string": T.StringType(), "varchar": T.StringType(), "integer": T.LongType(), "int64": T.LongType(), "bigint": T.LongType(), "number": T.DoubleType(),
    "float64": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "json": T.StringType(),
}


def filter_(frame: Frame, step: dict) -> Frame:
    return replace(frame, df=frame.df.where(condition(frame, step["where"])))


def select(frame: Frame, step: dict) -> Frame:
    pairs = [descriptor(f) for f in step["fields"]]
    distinct_names([name for _, name in pairs])
    return frame.project([field_of(frame, path)[0].alias(name) for path, name in pairs])


def drop(frame: Frame, step: dict) -> Frame:
    gone = set(step["fields"])
    for name in step["fields"]:
        exact(frame, name)
    return frame.project([quoted(c) for c in frame.columns if c not in gone]).warn("W_FIELDS_REMOVED", fields=list(step["fields"]))


def rename(frame: Frame, step: dict) -> Frame:
    new = step["fields"]
    for name in new:
        exact(frame, name)
    names = [new.get(c, c) for c in frame.columns]
    distinct_names(names)
    return frame.project([quoted(c).alias(n) for c, n in zip(frame.columns, names, strict=True)])


def derive(frame: Frame, step: dict) -> Frame:
    """The new column goes last, even when it replaces one."""
    name = step["field"]
    others = [c for c in frame.columns if c.lower() != name.lower()]
    distinct_names([*others, name])
    return frame.project([*[quoted(c) for c in others], expression(frame, step["expr"]).alias(name)])


def _cast(column: Column, source: T.DataType, target: str) -> Column:
    """Strict casts with decimals rounded half up and doubles half even on the way to integers."""
    kind = _TARGETS.get(target.lower())
    if kind is None:
        raise PlanError("E_CAST_TYPE", f"unknown cast target {target!r}", {"target": target})
    if target.lower() == "json":
        if isinstance(source, T.StringType):
            # parse_json raises on text that is not JSON; the text itself is kept
            return F.when(column.isNull() | F.parse_json(column).isNotNull(), column)
        return F.to_json(column) if isinstance(source, (T.StructType, T.ArrayType, T.MapType)) else F.when(column.isNotNull(), F.get_json_object(F.to_json(F.struct(column.alias("v"))), "$.v"))
    if isinstance(kind, T.LongType):
        if isinstance(source, T.DecimalType):
            return F.round(column, 0).cast(kind)
        if isinstance(source, (T.DoubleType, T.FloatType)):
            return F.rint(column).cast(kind)
        if isinstance(source, T.StringType):
            return F.when(column.rlike(r"^\s*[+-]?\d+\s*$"), F.when(column.rlike(r"^\s*[+-]?\d+\s*$"), column)).otherwise(F.round(column.cast(T.DecimalType(38, 10)), 0).cast("string")).cast(kind)
    if isinstance(source, (T.StructType, T.ArrayType, T.MapType)) and isinstance(kind, T.StringType):
        return F.to_json(column)
    return column.cast(kind)


def _lossy(column: Column, source: T.DataType, target: str) -> Column | None:
    """Rows that do not come back unchanged, for casts that can lose something."""
    kind = _TARGETS[target.lower()]
    loses = (
        (isinstance(source, (T.IntegralType, T.DecimalType)) and isinstance(kind, T.DoubleType))
        or (isinstance(source, (T.DoubleType, T.FloatType, T.DecimalType)) and isinstance(kind, T.LongType))
        or (isinstance(source, (T.TimestampType, T.TimestampNTZType)) and isinstance(kind, T.DateType))
    )
    if not loses:
        return None
    there = F.round(column, 0) if isinstance(source, T.DecimalType) and isinstance(kind, T.LongType) else F.rint(column) if isinstance(kind, T.LongType) else column
    back = there.try_cast(kind).try_cast(T.DecimalType(38, 0) if isinstance(source, T.IntegralType) else source)
    same = column.cast(T.DecimalType(38, 0)) if isinstance(source, T.IntegralType) else column
    return column.isNotNull() & ~back.eqNullSafe(same)


def _cast_map(step: dict) -> dict[str, str]:
    return step["fields"] if step.get("fields") else {step["field"]: step["to"]}


def cast(frame: Frame, step: dict) -> Frame:
    to = _cast_map(step)
    kinds = {name: exact(frame, name) for name in to}
    return frame.project([(_cast(quoted(c), kinds[c], to[c]) if c in to else quoted(c)).alias(c) for c in frame.columns])


def lossy_columns(frame: Frame, step: dict) -> list[Column]:
    """Aggregates: the rows that each cast changes beyond return, for casts that can."""
    checks = {n: _lossy(quoted(n), exact(frame, n), t) for n, t in _cast_map(step).items()}
    return [F.count_if(c).alias(n) for n, c in checks.items() if c is not None]


def lossy_counts(frame: Frame, step: dict):
    """One-row DataFrame of those counts; None if no cast can lose anything."""
    columns = lossy_columns(frame, step)
    return frame.df.agg(*columns) if columns else None


def sort(frame: Frame, step: dict) -> Frame:
    """Stable: the old order breaks ties. Nulls last in both directions unless asked otherwise."""
    new, extra = [], []
    for entry in step["by"]:
        spec = {"field": entry} if isinstance(entry, str) else entry
        name = hidden()
        extra.append(field_of(frame, spec["field"])[0].alias(name))
        new.append(Key(name, spec.get("direction", "asc") == "asc", spec.get("nulls", "last") == "last"))
    df = frame.df.select(*[quoted(c) for c in frame.columns], *extra, *frame.carried())
    return replace(frame, df=df, order=(*new, *frame.order))


def limit(frame: Frame, step: dict) -> Frame:
    df = frame.df.orderBy(*frame.keys()) if frame.order else frame.df
    if step.get("offset"):
        df = df.offset(step["offset"])
    return replace(frame, df=df.limit(step["count"]))


def dedupe(frame: Frame, step: dict) -> Frame:
    """Null keys equal each other; survivors keep their order."""
    keys = [field_of(frame, f)[0] for f in step["fields"]]
    flip = step.get("keep", "first") == "last"
    rank = hidden()
    window = Window.partitionBy(*keys).orderBy(*frame.keys(flip))
    return replace(frame, df=frame.df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank))


def unknown(step: dict) -> PlanError:
    return PlanError("E_UNKNOWN_OPERATION", f"{step.get('op')!r} does not apply here", {"op": step.get("op")})
