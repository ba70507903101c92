"""JSON values: strict parsing, type inference, rendering."""

from __future__ import annotations

import base64
import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.functions.kinds import INT64, normalised


def _no_twins(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise PlanError("E_DUPLICATE_KEY", "an object has a key twice")
    return out


def _constant(name):
    raise PlanError("E_PARSE", f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_float=Decimal, object_pairs_hook=_no_twins, parse_constant=_constant)


def parse_json(text: str):
    """Exact decimals, no duplicate keys, no NaN."""
    try:
        return _DECODER.decode(text)
    except (json.JSONDecodeError, RecursionError) as e:
        raise PlanError("E_PARSE", f"not valid JSON: {e}") from None


def parse_yaml(text: str):
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        loader.flatten_mapping(node)
        pairs = [(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value]
        for k, _ in pairs:
            if not isinstance(k, str):
                raise PlanError("E_NON_STRING_KEY", "object keys must be strings")
        return _no_twins(pairs)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return normalised(yaml.load(text, Strict))
    except yaml.YAMLError as e:
        raise PlanError("E_PARSE", f"not valid YAML: {e}") from None


class Kind:
    """Inferred type of a set of values: a small lattice that refuses to mix kinds."""

    __slots__ = ("element", "fields", "name", "scale", "whole")

    def __init__(self, name: str, whole: int = 0, scale: int = 0, fields: dict | None = None, element: Kind | None = None):
        self.name, self.whole, self.scale, self.fields, self.element = name, whole, scale, fields, element

    @staticmethod
    def of(v) -> Kind:
        if v is None:
            return Kind("null")
        if isinstance(v, bool):
            return Kind("boolean")
        if isinstance(v, int):
            digits = len(str(abs(v)))
            return Kind("integer", digits) if INT64[0] <= v <= INT64[1] else Kind("huge", digits)
        if isinstance(v, (float, Decimal)):
            v = normalised(v) if isinstance(v, float) else v
            if not v.is_finite():
                raise PlanError("E_NUMBER_INVALID", "numbers must be finite")
            _, digits, exponent = v.as_tuple()
            return Kind("decimal", max(len(digits) + exponent, 0), max(-exponent, 0))
        if isinstance(v, str):
            return Kind("string")
        if isinstance(v, dt.datetime):
            return Kind("timestamp")
        if isinstance(v, dt.date):
            return Kind("date")
        if isinstance(v, dict):
            for k in v:
                if not isinstance(k, str):
                    raise PlanError("E_NON_STRING_KEY", "object keys must be strings")
            return Kind("object", fields={k: Kind.of(x) for k, x in v.items()})
        if isinstance(v, (list, tuple)):
            element = Kind("null")
            for x in v:
                element = element.merged(Kind.of(x), "[]")
            return Kind("array", element=element)
        raise PlanError("E_TYPE_MISMATCH", f"values of type {type(v).__name__} are not data")

    def merged(self, other: Kind, path: str) -> Kind:
        if self.name == "null":
            return other
        if other.name == "null":
            return self
        numbers = {"integer", "huge", "decimal"}
        if self.name in numbers and other.name in numbers:
            name = "decimal" if "decimal" in (self.name, other.name) else "huge" if "huge" in (self.name, other.name) else "integer"
            return Kind(name, max(self.whole, other.whole), max(self.scale, other.scale))
        if self.name != other.name:
            raise PlanError("E_TYPE_MISMATCH", f"{path} mixes {self.name} and {other.name}", {"field": path})
        if self.name == "object":
            fields = dict(self.fields)
            for k, x in other.fields.items():
                fields[k] = fields[k].merged(x, f"{path}.{k}") if k in fields else x
            return Kind("object", fields=fields)
        if self.name == "array":
            return Kind("array", element=self.element.merged(other.element, path + "[]"))
        return self

    def spark(self) -> T.DataType:
        if self.name in ("huge", "decimal"):
            digits = max(self.whole + self.scale, 1)
            if digits > 38:
                raise PlanError("E_NUMBER_PRECISION", "a number needs more than 38 digits", {"digits": digits})
            return T.DecimalType(digits, self.scale)
        if self.name == "object":
            return T.StructType([T.StructField(k, v.spark()) for k, v in self.fields.items()]) if self.fields else T.MapType(T.StringType(), T.StringType())
        if self.name == "array":
            return T.ArrayType(self.element.spark())
        return {"null": T.StringType(), "string": T.StringType(), "boolean": T.BooleanType(), "integer": T.LongType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}[self.name]


def coerced(v, kind: T.DataType):
    """A value in the form Spark's row encoder takes for an inferred type."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(coerced(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [coerced(x, kind.elementType) for x in v]
    if isinstance(kind, T.DecimalType):
        return Decimal(repr(v)) if isinstance(v, float) else Decimal(v)
    return v


def public(v):
    """As shown in responses: decimals are fixed-point strings, dates ISO, bytes base64."""
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, float):
        if not (v == v and abs(v) != float("inf")):
            raise PlanError("E_NUMBER_INVALID", "numbers must be finite")
        return v
    if isinstance(v, (dt.date, dt.datetime, dt.time)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return {"base64": base64.b64encode(bytes(v)).decode()}
    if isinstance(v, dict):
        return {k: public(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: public(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple, set)):
        return [public(x) for x in v]
    return v


def canonical(v) -> str:
    return json.dumps(public(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)



def dumps(v, indent: int | None = None) -> str:
    """JSON with exact decimals as numbers, keys in their order."""

    def plain(x):
        if isinstance(x, Decimal):
            return x
        x = public(x) if not isinstance(x, (dict, list, tuple)) and not hasattr(x, "asDict") else x
        if hasattr(x, "asDict"):
            x = x.asDict()
        return {k: plain(y) for k, y in x.items()} if isinstance(x, dict) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x

    marks: dict[str, str] = {}

    def hide(x):
        if isinstance(x, Decimal):
            key = f"\u0001{len(marks)}\u0001"
            marks[key] = format(x, "f")
            return key
        return {k: hide(y) for k, y in x.items()} if isinstance(x, dict) else [hide(y) for y in x] if isinstance(x, list) else x

    out = json.dumps(hide(plain(v)), ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))
    for key, digits in marks.items():
        out = out.replace(json.dumps(key, ensure_ascii=False), digits, 1)
    return out
