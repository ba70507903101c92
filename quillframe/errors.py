"""The one error the engine raises, with a stable code."""

from __future__ import annotations

from typing import Any


class PlanError(Exception):
    """A coded refusal: why (``code`` for programs, the message for people), where (``step_id``) and with what values."""

    def __init__(self, code: str, message: str, details: dict[str, Any] | None = None, step_id: str | None = None):
        super().__init__(message)
        self.code, self.details, self.step_id = code, dict(details or ()), step_id

    def envelope(self, operation: str | None = None) -> dict[str, Any]:
        """The response of a call that ended so; what is not known is left out."""
        known = lambda **fields: {k: v for k, v in fields.items() if v is not None}
        return known(status="error", error=known(code=self.code, message=str(self), step_id=self.step_id, details=self.details or None), operation=operation)


#: Spark error conditions (prefixes) and the code they surface as.
_SPARK = [
    ("CAST_INVALID_INPUT", "E_CAST_FAILED"), ("CAST_OVERFLOW", "E_CAST_FAILED"), ("INVALID_JSON_RECORD", "E_CAST_FAILED"), ("MALFORMED_RECORD", "E_PARSE"),
    ("UNRESOLVED_COLUMN", "E_FIELD_NOT_FOUND"), ("FIELD_NOT_FOUND", "E_FIELD_NOT_FOUND"), ("DIVIDE_BY_ZERO", "E_EXPRESSION_DOMAIN"), ("DATATYPE_MISMATCH", "E_TYPE_MISMATCH"),
]


def translated(exc: Exception, step_id: str | None = None) -> PlanError:
    """A Spark failure as a coded error."""
    if isinstance(exc, PlanError):
        exc.step_id = exc.step_id or step_id
        return exc
    condition = ""
    try:
        condition = exc.getCondition() or ""
    except Exception:  # py4j errors carry the condition in their text only
        pass
    text = condition or str(exc)
    for mark, code in _SPARK:
        if condition.startswith(mark) or (not condition and f"[{mark}" in text):
            return PlanError(code, str(exc).splitlines()[0][:500], step_id=step_id)
    return PlanError("E_EXECUTION", str(exc).splitlines()[0][:500] if str(exc) else type(exc).__name__, step_id=step_id)
