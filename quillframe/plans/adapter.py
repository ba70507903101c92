"""Fit a source to a target JSON Schema: mappings, suggestions, and a draft plan."""

from __future__ import annotations

import unicodedata

_COMPOSED = ("$ref", "allOf", "anyOf", "oneOf", "not", "if", "then", "else")
SUGGESTIONS = 20


def folded(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", name).casefold() if c.isalnum())


def target_fields(schema: dict) -> tuple[list[dict] | None, str]:
    """Target fields of an object schema, or of an array of one object schema."""
    if not isinstance(schema, dict) or any(k in schema for k in _COMPOSED):
        return None, "composition is not supported"
    if schema.get("type") == "array":
        schema = schema.get("items")
        if not isinstance(schema, dict) or any(k in schema for k in _COMPOSED):
            return None, "array items must be one object schema"
    if schema.get("type") != "object" or not isinstance(schema.get("properties"), dict):
        return None, "the target is not an object schema with properties"
    needed, out = set(schema.get("required", [])), []
    for name, spec in schema["properties"].items():
        if not isinstance(spec, dict) or any(k in spec for k in _COMPOSED) or isinstance(spec.get("type"), list):
            return None, f"property {name!r} is not supported"
        out.append({"name": name, "type": spec.get("type"), "required": name in needed})
    return out, ""


def suggestions(target: str, sources: list[str]) -> tuple[list[dict], dict]:
    """Source fields for a target, each with how it was found, and the totals where the list is cut."""
    if target in sources:
        return [{"source": target, "method": "exact"}], {}
    near = sorted(s for s in sources if folded(s) == folded(target))
    listed = [{"source": s, "method": "normalized"} for s in near[:SUGGESTIONS]]
    return listed, {"total": len(near), "returned": SUGGESTIONS} if len(near) > SUGGESTIONS else {}


_TYPES = {"bigint": "integer", "int": "integer", "string": "string", "boolean": "boolean", "double": "number", "float": "number"}


def json_type(spark_type: str) -> str:
    base = spark_type.split("(")[0].split("<")[0]
    return _TYPES.get(base) or {"decimal": "number", "array": "array", "struct": "object", "map": "object"}.get(base, "string")


def fits(source: set[str], null_rows: int, target: str | None) -> str:
    """``source`` holds every type the field's values have; all of them must fit."""
    if target is None:
        return "schema_validation"
    if null_rows and target != "null":
        return "incompatible"
    taken = {target, "integer"} if target == "number" else {target}
    return "compatible" if source <= taken else "incompatible"


def score(fields: list[dict], sources: list[str], mappings: dict) -> int:
    total = 0
    for t in fields:
        exact = t["name"] in sources
        near = not exact and any(folded(s) == folded(t["name"]) for s in sources)
        total += 10_000 * (mappings.get(t["name"]) in sources) + (1000 if t["required"] else 10) * exact + (100 if t["required"] else 1) * near
    return total


def adapt(shape: dict, schema: dict, mappings: dict | None = None, source: dict | None = None) -> dict:
    """Status, field mappings, what is left open, and a draft plan where everything required is mapped."""
    mappings = mappings or {}
    fields, why = target_fields(schema)
    if fields is None:
        return {"status": "unsupported", "reason": why}
    chosen = None
    if shape["kind"] == "tree":
        sets = [(score(fields, [f["path"] for f in s["fields"]], mappings), s) for s in shape["record_sets"]]
        top = max((n for n, _ in sets), default=0)
        best = [s for n, s in sets if n == top]
        if shape.get("record_sets_truncated") or len(best) != 1:
            return {"status": "needs_source_selection", "candidates": [s["selector"] for s in best]}
        chosen = best[0]
        known = {f["path"]: ({"number" if t == "decimal" else t for t in f["types"]} or {"null"}, f["null"] + f["missing"]) for f in chosen["fields"]}
    else:
        known = {f["name"]: ({json_type(f["type"])}, f.get("null_count", 0)) for f in shape["fields"]}
    used, mapped, unresolved, omitted = [], [], [], []
    for t in fields:
        found = mappings.get(t["name"])
        options, cut = ([{"source": found, "method": "given"}], {}) if found else suggestions(t["name"], list(known))
        pick = options[0]["source"] if len(options) == 1 and options[0]["source"] in known else None
        fit = fits(*known[pick], t["type"]) if pick else None
        if pick and fit != "incompatible":
            mapped.append({"target": t["name"], "source": pick, "compatibility": fit})
            used.append(pick)
        elif t["required"]:
            unresolved.append({"target": t["name"], "suggestions": options, **({"suggestions_truncated": cut} if cut else {}), **({"compatibility": fit} if fit else {})})
        else:
            omitted.append(t["name"])
    out = {"status": "needs_mapping" if unresolved else "ready", "mappings": mapped, "unresolved": unresolved, "omitted": omitted, "dropped": [k for k in known if k not in used], "duplicated": sorted({u for u in used if used.count(u) > 1})}
    if chosen:
        out["selector"] = chosen["selector"]
    if not unresolved and mapped:
        src = dict(source or {})
        if chosen:
            src |= {"select": chosen["selector"]}
        select = {"op": "select", "id": "adapted", "fields": [m["source"] if m["source"] == m["target"] else {"field": m["source"], "as": m["target"]} for m in mapped]}
        whole = schema["items"] if schema.get("type") == "array" else schema
        counts = {k: schema[j] for k, j in (("min", "minItems"), ("max", "maxItems")) if schema.get("type") == "array" and j in schema}
        out["plan"] = {"version": "1", "sources": {"source": src}, "steps": [select], "schema": whole, **({"assert": [{"type": "row_count", **counts}]} if counts else {})}
    return out
