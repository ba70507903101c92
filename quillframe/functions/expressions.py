"""The scalar expressions of ``derive``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import Frame, field_of
from quillframe.functions.kinds import NUMERIC, compatible, family, literal

_ARITHMETIC = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b}


def _kind(frame: Frame, column: Column) -> T.DataType:
    return frame.df.select(column.alias("x")).schema[0].dataType


def _numeric(frame: Frame, columns: list[Column], op: str) -> None:
    for c in columns:
        got = family(_kind(frame, c))
        if not (got in NUMERIC or got == "null"):
            raise PlanError("E_TYPE_MISMATCH", f"{op} needs numbers, got {got}")


def _rounded(x: Column, digits: int) -> Column:
    """Halves of the scaled binary value away from zero. Spark's own ``round`` goes by a double's shortest spelling, where
    19570.815 is a half although the value is below it. From 2**52 on a scaled value is whole; NaN and infinity stay."""
    factor = float(10 ** abs(digits))
    scaled = F.abs(x * factor if digits >= 0 else x / factor)
    whole = F.floor(scaled)
    up = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)).cast("double") * F.signum(x)
    return F.when(scaled >= float(1 << 52), x).otherwise(up / factor if digits >= 0 else up * factor)


def expression(frame: Frame, spec: dict) -> Column:
    (op, arg), *_ = spec.items()
    if op == "field":
        return field_of(frame, arg)[0]
    if op == "value":
        return literal(arg)
    if op in _ARITHMETIC:
        parts = [expression(frame, a) for a in arg]
        _numeric(frame, parts, op)
        return reduce(_ARITHMETIC[op], parts)
    if op == "divide":
        parts = [expression(frame, a) for a in arg]
        _numeric(frame, parts, op)
        return parts[0].cast("double") / parts[1].cast("double")  # ANSI mode raises on zero
    if op == "concat":
        parts = []
        for a in arg:
            c = expression(frame, a)
            kind = family(_kind(frame, c))
            if kind not in NUMERIC | {"string", "boolean", "null", "date", "timestamp"}:
                raise PlanError("E_TYPE_MISMATCH", f"concat cannot render {kind}")
            parts.append(c.cast("string"))
        return F.concat_ws("", *parts)
    if op == "coalesce":
        parts = [expression(frame, a) for a in arg]
        kinds = [family(_kind(frame, c)) for c in parts]
        seen = {k for k in kinds if k != "null"}
        if any(not compatible(a, b) for a in seen for b in seen):
            # an operand without a single value takes no part: decided by the data, in one aggregate
            counts = frame.df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(parts)]).first()
            parts = [c for i, c in enumerate(parts) if counts[i]]
            kinds = [family(_kind(frame, c)) for c in parts]
            if not all(compatible(a, b) for a in kinds for b in kinds):
                raise PlanError("E_TYPE_MISMATCH", "coalesce operands are of different types", {"types": sorted(seen)})
        return F.coalesce(*parts) if parts else F.lit(None).cast("string")
    if op in ("lower", "upper", "substring"):
        inner = expression(frame, arg[0] if op == "substring" else arg)
        if family(_kind(frame, inner)) not in ("string", "null"):
            raise PlanError("E_FIELD_NOT_FOUND", f"{op} needs a string")
        if op != "substring":
            return F.lower(inner) if op == "lower" else F.upper(inner)
        start, size = arg[1], arg[2] if len(arg) > 2 else None
        if not (size is None or size >= 0):
            raise PlanError("E_EXPRESSION_INVALID", "a length cannot be negative")
        if start == 0 and size is not None:  # position 0 takes up one character of the length
            start, size = 1, max(size - 1, 0)
        return F.substring(inner, start, 2_147_483_647 if size is None else size)
    if op == "round":
        inner, digits = (expression(frame, arg), 0) if isinstance(arg, dict) else (expression(frame, arg[0]), arg[1] if len(arg) > 1 else 0)
        if not (-30 <= digits <= 30):
            raise PlanError("E_EXPRESSION_INVALID", "round takes -30 to 30 digits")
        _numeric(frame, [inner], op)
        if isinstance(_kind(frame, inner), (T.DoubleType, T.FloatType)):
            return _rounded(inner.cast("double"), digits)
        return F.round(inner, digits)
    raise PlanError("E_EXPRESSION_INVALID", f"unknown expression {op!r}")
