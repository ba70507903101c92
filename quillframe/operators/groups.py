"""join and group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import Frame, Key, descriptor, distinct_names, field_of, hidden, quoted
from quillframe.functions.kinds import NUMERIC, compatible, family

AGGREGATES = ("sum", "avg", "min", "max", "count", "count_distinct", "first", "last")


def aggregate(frame: Frame, op: str, column: Column | None, name: str = "") -> Column:
    if op == "count":
        return F.count(F.lit(1)) if column is None else F.count(column)
    if op == "count_distinct":
        return F.count_distinct(column)
    kind = frame.df.select(column.alias("x")).schema[0].dataType
    if op in ("sum", "avg"):
        if family(kind) not in NUMERIC:
            raise PlanError("E_TYPE_MISMATCH", f"{op} needs numbers", {"field": name})
        if op == "avg":
            return F.avg(column.cast("double"))
        if isinstance(kind, T.IntegralType):
            return F.sum(column.cast(T.DecimalType(38, 0)))
        # the scale stays, the sum has all 38 digits
        return F.sum(column).cast(T.DecimalType(38, kind.scale)) if isinstance(kind, T.DecimalType) else F.sum(column)
    if op in ("min", "max"):
        return F.min(column) if op == "min" else F.max(column)
    # first and last of the row order, nulls included
    if all(k.ascending for k in frame.order) and frame.order:
        place = F.struct(*[p for k in frame.order for p in (F.col(k.name).isNull() if k.nulls_last else F.col(k.name).isNotNull(), F.col(k.name))])
        held = F.struct(column.alias("v"))
        return (F.min_by(held, place) if op == "first" else F.max_by(held, place)).getField("v")
    return (F.first(column) if op == "first" else F.last(column))


def group(frame: Frame, step: dict) -> Frame:
    from quillframe.operators.shapes import _grouped

    by = [descriptor(b) for b in step.get("by") or []]
    ordered = frame
    if any(a["op"] in ("first", "last") for a in step["aggregates"]) and not (frame.order and all(k.ascending for k in frame.order)):
        # descending keys: number the rows of each group instead
        from pyspark.sql import Window

        name = hidden()
        window = Window.partitionBy(*([field_of(frame, p)[0] for p, _ in by] or [F.lit(1)])).orderBy(*frame.keys())
        ordered = Frame(frame.df.withColumn(name, F.row_number().over(window)), (Key(name),))
    names, columns = [], []
    for a in step["aggregates"]:
        path = a.get("field")
        names.append(a.get("as") or (f"{a['op']}_{path.split('.')[-1]}" if path else "count_rows"))
        columns.append(aggregate(ordered, a["op"], field_of(ordered, path)[0] if path else None, path or ""))
    distinct_names([*[n for _, n in by], *names])
    return _grouped(ordered, by, [c.alias(n) for c, n in zip(columns, names, strict=True)])


def join(left: Frame, right: Frame, step: dict) -> Frame:
    """Equi-join; null keys never match, both key columns stay, colliding right names take the prefix."""
    how, prefix = step.get("type", "inner"), step.get("right_prefix", "right_")
    l_map, r_map = {}, {}
    lk, rk = [], []
    for a, b in step["on"]:
        (lc, lt), (rc, rt) = field_of(left, a), field_of(right, b)
        if not compatible(family(lt), family(rt)):
            raise PlanError("E_TYPE_MISMATCH", f"join keys {a!r} and {b!r} are of different types", {"left": family(lt), "right": family(rt)})
        lk.append(lc.alias(hidden()))
        rk.append(rc.alias(hidden()))
    taken = {c.lower() for c in left.columns}
    out = [*left.columns]
    for c in right.columns:
        r_map[c] = prefix + c if c.lower() in taken else c
        out.append(r_map[c])
    distinct_names(out)
    mark = lambda frame, keys: (frame, keys, hidden())
    sides = []
    for frame, keys, flag in (mark(left, lk), mark(right, rk)):
        order = [(k, hidden()) for k in frame.order]
        names = [hidden() for _ in frame.columns]
        df = frame.df.select(*[quoted(c).alias(n) for c, n in zip(frame.columns, names, strict=True)], *keys, *[F.col(k.name).alias(n) for k, n in order], F.lit(False).alias(flag))
        sides.append((df, names, order, flag))
    (ldf, lnames, lorder, lflag), (rdf, rnames, rorder, rflag) = sides
    l_keys = ldf.columns[len(lnames) : len(lnames) + len(lk)]
    r_keys = rdf.columns[len(rnames) : len(rnames) + len(rk)]
    met = ldf.join(rdf, reduce(lambda a, b: a & b, [ldf[a] == rdf[b] for a, b in zip(l_keys, r_keys, strict=True)]), {"full": "full_outer"}.get(how, how))
    l_map = dict(zip(left.columns, lnames, strict=True))
    columns = [F.col(l_map[c]).alias(c) for c in left.columns] + [F.col(n).alias(r_map[c]) for c, n in zip(right.columns, rnames, strict=True)]
    keys = []
    for flag, order in ((lflag, lorder), (rflag, rorder)):
        columns.append(F.coalesce(F.col(flag), F.lit(True)).alias(flag))  # rows without this side come last
        columns += [F.col(n) for _, n in order]
        keys += [Key(flag), *[Key(n, k.ascending, k.nulls_last) for k, n in order]]
    return Frame(met.select(*columns), tuple(keys))


def join_effects(left: Frame, right: Frame, step: dict) -> DataFrame:
    """One row: pairs, matched and unmatched rows of both sides, fan-out rows. Joins per-key counts, not rows."""
    n, sides = len(step["on"]), []
    for frame, at, count in ((left, 0, "nl"), (right, 1, "nr")):
        keys = [field_of(frame, pair[at])[0].alias(f"k{i}") for i, pair in enumerate(step["on"])]
        sides.append(frame.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)))
    l, r = sides  # noqa: E741
    both = l.join(r, [l[f"k{i}"] == r[f"k{i}"] for i in range(n)], "full_outer").select("nl", "nr")
    hit = F.col("nl").isNotNull() & F.col("nr").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        total(F.when(hit, F.col("nl") * F.col("nr"))).alias("matched_pairs"),
        total(F.when(hit, F.col("nl"))).alias("left_matched"),
        total(F.when(hit, F.col("nr"))).alias("right_matched"),
        total(F.when(~hit, F.col("nl"))).alias("left_unmatched"),
        total(F.when(~hit, F.col("nr"))).alias("right_unmatched"),
        total(F.when(hit & (F.col("nr") > 1), F.col("nl"))).alias("left_fanout"),
    )
