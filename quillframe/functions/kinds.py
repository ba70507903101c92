"""Type families and literals. Nothing is coerced: Spark would compare '1' with 1, plans must not."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError

NUMERIC = {"integer", "decimal", "number"}
INT64 = (-(1 << 63), (1 << 63) - 1)


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.FractionalType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NullType):
        return "null"
    return "timestamp" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else kind.simpleString().lower()


def compatible(a: str, b: str) -> bool:
    return a == b or (a in NUMERIC and b in NUMERIC)


def normalised(value):
    """Floats by their shortest spelling as exact decimals, inside lists and objects too."""
    if isinstance(value, float):
        if not (value == value and value not in (float("inf"), float("-inf"))):
            raise PlanError("E_NUMBER_INVALID", "numbers must be finite")
        return Decimal(repr(value))
    if isinstance(value, list):
        return [normalised(v) for v in value]
    if isinstance(value, dict):
        return {k: normalised(v) for k, v in value.items()}
    return value


def decimal_kind(value: Decimal) -> T.DecimalType:
    _, digits, exponent = value.as_tuple()
    scale = max(0, -exponent)
    whole = max(len(digits) + exponent, 0) if exponent > 0 else max(len(digits) - scale, 0)
    if whole + scale > 38:
        raise PlanError("E_NUMBER_PRECISION", "a number needs more than 38 digits", {"value": str(value)})
    return T.DecimalType(max(whole + scale, 1), scale)


def literal_kind(value) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if INT64[0] <= value <= INT64[1] else decimal_kind(Decimal(value))
    if isinstance(value, (float, Decimal)):
        return decimal_kind(normalised(value) if isinstance(value, float) else value)
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, dt.datetime):
        return T.TimestampNTZType()
    if isinstance(value, dt.date):
        return T.DateType()
    raise PlanError("E_TYPE_MISMATCH", "lists and objects are not scalar literals", {"type": type(value).__name__})


def literal_family(value) -> str:
    return "datetime" if isinstance(value, dt.datetime) else family(literal_kind(value))


def literal(value) -> Column:
    kind = literal_kind(value)
    if isinstance(kind, T.DecimalType):
        return F.lit(str(normalised(value) if isinstance(value, float) else value)).cast(kind)
    return F.lit(value).cast(kind) if value is not None else F.lit(None)
