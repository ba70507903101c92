"""A lazy table with its row order.

Order is a specification: hidden columns beside the user's, and a direction for each. It costs nothing until a
sink, limit, dedupe or first/last needs it, and Catalyst prunes hidden columns that nothing reads.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError

HIDDEN = "__qf_"
_numbers = itertools.count()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hidden() -> str:
    return f"{HIDDEN}o{next(_numbers)}"


@dataclass(frozen=True)
class Key:
    name: str
    ascending: bool = True
    nulls_last: bool = True

    def column(self, flip: bool = False) -> Column:
        c, up, last = F.col(self.name), self.ascending != flip, self.nulls_last != flip
        if up:
            return c.asc_nulls_last() if last else c.asc_nulls_first()
        return c.desc_nulls_last() if last else c.desc_nulls_first()


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order: tuple[Key, ...] = ()
    warnings: tuple[dict, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if not f.name.startswith(HIDDEN)])

    @property
    def visible(self) -> DataFrame:
        """User columns in no particular order of rows."""
        return self.df.select(*[quoted(c) for c in self.columns])

    @property
    def sorted(self) -> DataFrame:
        """User columns in row order (a range-partitioned sort)."""
        df = self.df.orderBy(*[k.column() for k in self.order]) if self.order else self.df
        return df.select(*[quoted(c) for c in self.columns])

    def numbered(self, name: str) -> DataFrame:
        """The frame's rows with their place from 1: sorted over partitions, each of which starts after the sizes of those
        before it, so that no task holds all rows."""
        spark = self.df.sparkSession
        at = self.df.schema.add(name, "long")
        placed = (self.df.orderBy(*self.keys()) if self.order else self.df).rdd.zipWithIndex()
        return spark.createDataFrame(placed.map(lambda x: (*x[0], x[1] + 1)), at)

    def keys(self, flip: bool = False) -> list[Column]:
        return [k.column(flip) for k in self.order] or [F.lit(1)]

    def carried(self) -> list[Column]:
        return [F.col(k.name) for k in self.order]

    def project(self, columns: Iterable[Column], **changes) -> Frame:
        """Replace the user columns; hidden order columns ride along."""
        return replace(self, df=self.df.select(*columns, *self.carried()), **changes)

    def warn(self, code: str, **details) -> Frame:
        return replace(self, warnings=(*self.warnings, {"code": code, **details}))


def field_of(frame: Frame, path: str) -> tuple[Column, T.DataType]:
    """A dotted path; there is no escape for dots."""
    names = path.split(".")
    fields = {f.name.lower(): f for f in frame.schema.fields}
    found = fields.get(names[0].lower())
    if not (found is not None and all(names)):
        raise PlanError("E_FIELD_NOT_FOUND", f"field {path!r} does not exist", {"field": path})
    column, kind = quoted(found.name), found.dataType
    for name in names[1:]:
        if not isinstance(kind, T.StructType):
            raise PlanError("E_FIELD_NOT_FOUND", f"field {path!r} does not exist", {"field": path})
        inner = {f.name.lower(): f for f in kind.fields}.get(name.lower())
        if inner is None:
            raise PlanError("E_FIELD_NOT_FOUND", f"field {path!r} does not exist", {"field": path})
        column, kind = column.getField(inner.name), inner.dataType
    return column, kind


def exact(frame: Frame, name: str) -> T.DataType:
    """A top-level column by its exact name."""
    for f in frame.schema.fields:
        if f.name == name:
            return f.dataType
    raise PlanError("E_FIELD_NOT_FOUND", f"field {name!r} does not exist", {"field": name})


def distinct_names(names: list[str]) -> None:
    low = [n.lower() for n in names]
    again = sorted({n for n in low if low.count(n) > 1})
    if again:
        raise PlanError("E_DUPLICATE_FIELD", "output names are not unique", {"fields": again})
    if any(n.startswith(HIDDEN) for n in low):
        raise PlanError("E_RESERVED_FIELD", f"names starting with {HIDDEN} are reserved")


def descriptor(entry) -> tuple[str, str]:
    """(path, output name) of a plain path or ``{field, as}``."""
    if isinstance(entry, str):
        return entry, entry.split(".")[-1]
    return entry["field"], entry.get("as") or entry["field"].split(".")[-1]
