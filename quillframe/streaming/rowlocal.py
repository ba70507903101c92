"""Plans over streams, an extra: steps that look at one row at a time run unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillframe.errors import PlanError
from quillframe.frame import Frame
from quillframe.operators import rows, shapes
from quillframe.plans import model

ROW_LOCAL = {"filter": rows.filter_, "select": rows.select, "drop": rows.drop, "rename": rows.rename, "derive": rows.derive, "cast": rows.cast, "explode": shapes.explode, "unpivot": shapes.unpivot, "flatten": shapes.flatten, "unflatten": shapes.unflatten}


def on_stream(stream: DataFrame, steps: list[dict]) -> DataFrame:
    frame = Frame(stream)
    for raw in steps:
        step = model.checked(model.step, raw, "the step is invalid")
        if step["op"] not in ROW_LOCAL:
            raise PlanError("E_UNKNOWN_OPERATION", f"{step['op']!r} needs more than one row and does not run on streams", {"op": step["op"]})
        frame = ROW_LOCAL[step["op"]](frame, step)
    return frame.visible
