"""Budgets of a call: defaults, hard ceilings, and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from quillframe.errors import PlanError

#: Name -> (default, hard maximum).
BOUNDS = {
    "max_input_bytes": (512 << 20, 8 << 30),
    "max_sources": (16, 100),
    "max_rows": (5_000_000, 50_000_000),
    "max_items": (5_000_000, 50_000_000),
    "max_depth": (100, 500),
    "max_steps": (100, 100),
    "max_memory_mb": (512, 4096),
    "max_temp_bytes": (2 << 30, 16 << 30),
    "timeout_ms": (30_000, 300_000),
    "max_inline_bytes": (64 << 10, 1 << 20),
    "max_response_bytes": (256 << 10, 1 << 20),
    "sample_rows": (5, 100),
}
_LEAST_RESPONSE = 256


def items_of(value) -> int:
    """How many values a JSON value holds: itself and all below."""
    n, pending = 0, [value]
    while pending:
        v = pending.pop()
        n += 1
        pending.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
    return n


@dataclass(frozen=True)
class Limits:
    """``enforce`` False lifts the byte, row and item budgets (cluster use); memory and temp space are Spark's settings."""

    values: dict
    enforce: bool = True

    def __getattr__(self, name: str):
        try:
            return self.values[name]
        except KeyError:
            raise AttributeError(name) from None

    @staticmethod
    def of(raw: dict | None = None, returns: dict | None = None, enforce: bool = True) -> Limits:
        asked = {k: v for k, v in {**(raw or {}), **{k: v for k, v in (returns or {}).items() if k in ("max_inline_bytes", "sample_rows")}}.items() if v is not None}
        values = {}
        for name, (default, most) in BOUNDS.items():
            v = asked.pop(name, default)
            if isinstance(v, bool) or not isinstance(v, int) or v < 0 or (v == 0 and name not in ("sample_rows", "max_sources", "max_steps")):
                raise PlanError("E_LIMIT_INVALID", f"{name} must be a positive integer", {"field": name, "value": v})
            if v > most:
                raise PlanError("E_LIMIT_INVALID", f"{name} exceeds the hard maximum", {"field": name, "requested": v, "maximum": most})
            values[name] = v
        if asked:
            raise PlanError("E_LIMIT_INVALID", "unknown limits", {"fields": sorted(asked)})
        if values["max_response_bytes"] < _LEAST_RESPONSE:
            raise PlanError("E_LIMIT_INVALID", "max_response_bytes is too small", {"minimum": _LEAST_RESPONSE})
        return Limits(values, enforce)

    def hold(self, items: int, what: str) -> None:
        """Refuse what has more items than the budget allows."""
        if self.enforce and items > self.max_items:
            raise PlanError("E_ITEM_LIMIT", f"{what} exceeds the item budget", {"items": items, "maximum": self.max_items})
