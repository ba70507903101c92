"""Selectors: an optional ``$`` (and dot), then names, ``[n]`` and ``[*]``; an empty one is the whole value."""

from __future__ import annotations

import re

from quillframe.errors import PlanError

_STEP = r"[A-Za-z_][A-Za-z0-9_-]*|\[(?:[0-9]+|\*)\]"
#: A name needs a dot before it unless it comes first; a bracket may have one.
_WHOLE = re.compile(rf"(?:{_STEP})(?:\.(?:{_STEP})|\[(?:[0-9]+|\*)\])*")
_STEPS = re.compile(_STEP)


def parsed(selector: str) -> list:
    """Parts: strings are names, ints are places, None is every element."""
    path = re.sub(r"^\$\.?", "", selector.strip())
    fits = _WHOLE.match(path)
    if path and (not fits or fits.end() < len(path)):
        raise PlanError("E_SELECTOR_SYNTAX", f"selector {selector!r} is not valid", {"position": fits.end() if fits else 0})
    steps = _STEPS.findall(path)
    return [s if s[0] != "[" else None if s == "[*]" else int(s[1:-1]) for s in steps]


def selected(value, selector: str):
    now, many = [value], False
    for part in parsed(selector):
        found = []
        for v in now:
            if not isinstance(part, str):
                if not isinstance(v, list):
                    raise PlanError("E_SELECTOR_TYPE", "[n] and [*] need an array")
                if part is not None and part >= len(v):
                    raise PlanError("E_SELECTOR_NOT_FOUND", f"no element {part}", {"selector": selector})
                found += v if part is None else [v[part]]
            elif isinstance(v, dict) and part in v:
                found.append(v[part])
            else:
                raise PlanError("E_SELECTOR_NOT_FOUND", f"no field {part!r}", {"selector": selector})
        now, many = found, many or part is None
    return now if many else now[0]
