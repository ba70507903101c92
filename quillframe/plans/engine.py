"""The four verbs: inspect, transform, validate and diff.

``Engine.frames`` compiles a plan to lazy frames and runs nothing; the verbs add counting, checking and publishing.
Row counts of all steps, the figures behind warnings and the forcing of casts and arithmetic are observed in one pass over
the plan (one more for each ``limit``, since that need not read all of its input).
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from dataclasses import dataclass, replace

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.errors import PlanError, translated
from quillframe.frame import Frame, exact, quoted
from quillframe.limits import Limits, items_of
from quillframe.operators import groups, rows, shapes
from quillframe.plans import adapter, checks, differ, model, profile
from quillframe.sources import sinks, trees
from quillframe.sources.readers import Data, load, promoted
from quillframe.sources.values import canonical, public

_TABULAR = {
    "filter": rows.filter_, "select": rows.select, "drop": rows.drop, "rename": rows.rename, "derive": rows.derive, "cast": rows.cast, "sort": rows.sort, "limit": rows.limit,
    "dedupe": rows.dedupe, "explode": shapes.explode, "pivot": shapes.pivot, "unpivot": shapes.unpivot, "flatten": shapes.flatten, "unflatten": shapes.unflatten, "group": groups.group,
}
#: Session settings that results depend on.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.decimalOperations.allowPrecisionLoss": "false", "spark.sql.ansi.enabled": "true"}
_EFFECT_CAP = 1000


def _capped(effects: dict) -> dict:
    """Long lists cut, with what they held in all."""
    long = {k: len(v) for k, v in effects.items() if isinstance(v, list) and k != "warnings" and len(v) > _EFFECT_CAP}
    cut = {k: v[:_EFFECT_CAP] if k in long else v for k, v in effects.items()}
    return cut | ({"truncated": {k: {"total": n, "returned": _EFFECT_CAP} for k, n in long.items()}} if long else {})


@dataclass
class Step:
    id: str
    op: str
    inputs: list[str]
    data: Data
    spec: dict


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, strict_errors: bool = True, enforce_limits: bool = True):
        self.spark, self.root, self.strict, self.enforce = spark, root, strict_errors, enforce_limits
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)

    # ------------------------------------------------------------ compiling

    def apply(self, step: dict, data: dict[str, Data], previous: str | None, sources: list[str]) -> tuple[list[str], Data]:
        if step["op"] == "join":
            names = [step["left"], step["right"]]
        else:
            name = step.get("source") or previous or (sources[0] if len(sources) == 1 else None)
            if name is None:
                raise PlanError("E_SOURCE_REFERENCE", "the step does not say which source it reads")
            names = [name]
        for n in names:
            if n not in data:
                raise PlanError("E_SOURCE_REFERENCE", f"{n!r} is not a source or an earlier step", {"source": n})
        got = [data[n] for n in names]
        if step["op"] == "join":
            if not all(d.kind == "table" for d in got):
                raise PlanError("E_TYPE_MISMATCH", "join needs two tables")
            return names, Data("table", groups.join(got[0].frame, got[1].frame, step))
        if got[0].kind == "tree":
            return names, Data("tree", value=trees.applied(got[0].value, step))
        if step["op"] not in _TABULAR:
            raise rows.unknown(step)
        return names, Data("table", _TABULAR[step["op"]](got[0].frame, step))

    @staticmethod
    def _forced(step: dict) -> list[str]:
        """Columns that must be computed where they stand: casts and arithmetic fail there, even if a later step would
        drop the bad rows or the column."""
        if step["op"] == "cast":
            return list(step.get("fields") or {step["field"]: 0})
        if step["op"] == "derive" and any(k in str(step["expr"]) for k in ("divide", "add", "subtract", "multiply")):
            return [step["field"]]
        return []

    def _blamed(self, steps: list[Step]) -> None:
        """Find the step at which an observed pass failed: each step's forced columns in a job of their own."""
        for s in steps:
            names = self._forced(s.spec) if s.data.kind == "table" else []
            if names:
                try:
                    s.data.frame.df.agg(*[F.count(quoted(n)) for n in names]).collect()
                except Exception as e:
                    raise translated(e, s.id) from e

    def _measured(self, data: dict[str, Data], steps: list[Step], sources: list[str], full: bool) -> dict[str, dict]:
        """Figures of each named table (``n`` rows) and of inputs of explodes and casts (``in:<step>``), from passes over a
        copy of the plan in which each of them is observed. What a pass did not reach (a side that adaptive execution left
        out because the other is empty) is counted on its own."""
        tag = uuid.uuid4().hex
        seen: dict[str, Data] = {}

        def watched(name: str, frame: Frame, figures: list) -> Frame:
            return replace(frame, df=frame.df.observe(f"{tag}:{name}", *figures))

        rows_of = lambda f, names: [F.count(F.lit(1)).alias("n"), *profile.item_figures(f), *[F.count(quoted(c)).alias(f"forced{i}") for i, c in enumerate(names)]]
        for name in sources:
            d = data[name]
            seen[name] = replace(d, frame=watched(name, d.frame, rows_of(d.frame, []))) if d.kind == "table" else d
        asked: dict[str, tuple[Frame, list]] = {}
        for s in steps:
            if s.data.kind != "table":
                seen[s.id] = s.data
                continue
            first = seen[s.inputs[0]]
            figures = []
            if full and s.op == "explode":
                figures = [F.count_if(F.coalesce(F.size(quoted(s.spec["field"])), F.lit(0)) <= 0).alias("empty")]
            if full and s.op == "cast":
                figures = rows.lossy_columns(first.frame, s.spec)
            inputs = dict(seen)
            if figures:
                asked[f"in:{s.id}"] = (data[s.inputs[0]].frame, figures)
                inputs[s.inputs[0]] = replace(first, frame=watched(f"in:{s.id}", first.frame, figures))
            out = self.apply(s.spec, inputs, s.inputs[0], sources)[1]
            seen[s.id] = replace(out, frame=watched(s.id, out.frame, rows_of(out.frame, self._forced(s.spec))))
        above = {s.id: s for s in steps}

        def reached(name: str) -> set[str]:
            """The tables that a pass to ``name`` surely reads in full."""
            names = {name}
            s = above.get(name)
            if s is not None:
                names |= {f"in:{name}"} if f"in:{name}" in asked else set()
                for i in s.inputs if s.op != "limit" else []:
                    names |= reached(i)
            return names

        tables = [n for n in (*sources, *above) if seen[n].kind == "table"]
        wanted = set(tables) | set(asked) if full else {s.id for s in steps if self._forced(s.spec)}
        got: dict[str, dict] = {}
        for name in reversed(tables):
            todo = reached(name) & wanted - set(got)
            if not todo:
                continue
            job = seen[name].frame.df.agg(F.count(F.lit(1)))
            job.collect()
            found = job._jdf.queryExecution().observedMetrics().iterator()
            while found.hasNext():
                entry = found.next()
                label, row = entry._1().removeprefix(f"{tag}:"), entry._2()
                if label in todo:
                    got[label] = {c: row.get(i) for i, c in enumerate(row.schema().fieldNames())}
            for label in sorted(todo - set(got)):
                frame, figures = asked[label] if label in asked else (data[label].frame, rows_of(data[label].frame, self._forced(above[label].spec) if label in above else []))
                got[label] = frame.df.agg(*figures).first().asDict()
        return got

    @staticmethod
    def _held(limits: Limits, data: dict[str, Data], steps: list[Step], sources: list[str], figures: dict[str, dict]) -> None:
        """The item budget: sources share one, every step's result has its own. Tables that were not counted are left out."""
        items = lambda name: (data[name].items if data[name].items is not None else items_of(data[name].value) if data[name].kind == "tree" else profile.table_items(data[name].frame, figures[name]) if name in figures else 0)
        if limits.enforce:
            limits.hold(sum(items(name) for name in sources), "what the sources hold together")
            for s in steps:
                limits.hold(items(s.id), f"the result of step {s.id!r}")

    @staticmethod
    def _counted(limits: Limits, *loaded: Data) -> None:
        """The item budget of a verb's sources, tables in one pass each."""
        if not limits.enforce:
            return
        total = 0
        for d in loaded:
            total += d.items if d.items is not None else profile.table_items(d.frame, d.frame.df.agg(F.count(F.lit(1)).alias("n"), *profile.item_figures(d.frame)).first().asDict())
            limits.hold(total, "what the sources hold together")

    def run_steps(self, plan: dict, limits: Limits) -> tuple[dict[str, Data], list[Step]]:
        if len(plan["sources"]) > limits.max_sources:
            raise PlanError("E_SOURCE_LIMIT", "too many sources")
        if len(plan["steps"]) > limits.max_steps:
            raise PlanError("E_STEP_LIMIT", "too many steps")
        data = {name: load(self.spark, spec, limits, self.root) for name, spec in plan["sources"].items()}
        total = sum(d.bytes for d in data.values())
        if not (not limits.enforce or total <= limits.max_input_bytes):
            raise PlanError("E_INPUT_TOO_LARGE", "the sources exceed the input budget", {"bytes": total})
        done: list[Step] = []
        for i, step in enumerate(plan["steps"]):
            sid = step.get("id") or f"step_{i + 1}"
            try:
                if sid in data:
                    raise PlanError("E_DUPLICATE_ID", f"{sid!r} is taken", {"id": sid})
                names, out = self.apply(step, data, done[-1].id if done else None, list(plan["sources"]))
            except Exception as e:
                raise translated(e, sid) from e
            data[sid] = out
            done.append(Step(sid, step["op"], names, out, step))
        return data, done

    def frames(self, plan: dict) -> dict[str, Data]:
        """Every named dataset of a plan, lazily; nothing is run but what schemas need."""
        checked = model.plan(plan)
        return self.run_steps(checked, Limits.of(checked.get("limits"), enforce=False))[0]

    def frame(self, plan: dict) -> Frame:
        """The last step's frame."""
        checked = model.plan(plan)
        return self.run_steps(checked, Limits.of(checked.get("limits"), enforce=False))[1][-1].data.frame

    def over(self, tables: dict[str, Frame], steps: list[dict]) -> Frame:
        """Steps over frames that are at hand, compiled lazily; how a program uses plans on tables of its own."""
        data, last = {name: Data("table", f) for name, f in tables.items()}, None
        for i, raw in enumerate(steps):
            step = model.checked(model.step, raw, "the step is invalid")
            last = step.get("id") or f"step_{i + 1}"
            if last in data:
                raise PlanError("E_DUPLICATE_ID", f"{last!r} is taken", {"id": last})
            data[last] = self.apply(step, data, f"step_{i}" if i and "id" not in steps[i - 1] else (steps[i - 1]["id"] if i else None), list(tables))[1]
        return data[last].frame

    def query(self, plan: dict, ordered: bool = False) -> DataFrame:
        """The last step's rows."""
        frame = self.frame(plan)
        return frame.sorted if ordered else frame.visible

    # ------------------------------------------------------------ running under a budget

    def _within(self, limits: Limits, operation: str, work) -> dict:
        """Run ``work`` in a job group that a watchdog cancels when time is up; errors become envelopes."""
        group, box = f"quillframe-{uuid.uuid4().hex}", {}

        def body():
            self.spark.sparkContext.setJobGroup(group, operation, interruptOnCancel=True)
            try:
                box["value"] = work()
            except BaseException as e:  # handed to the caller below
                box["error"] = e

        if not self.enforce:
            body()
        else:
            thread = InheritableThread(target=body, daemon=True)
            thread.start()
            thread.join(limits.timeout_ms / 1000)
            if thread.is_alive():
                self.spark.sparkContext.cancelJobGroup(group)
                thread.join(10)
                return PlanError("E_TIMEOUT", "the call took longer than its budget", {"timeout_ms": limits.timeout_ms}).envelope(operation)
        if "error" in box:
            return translated(box["error"]).envelope(operation)
        out = box["value"]
        size = len(canonical(out).encode())
        if size > limits.max_response_bytes:
            return PlanError("E_RESPONSE_TOO_LARGE", "the response exceeds its budget", {"bytes": size}).envelope(operation)
        return out

    def _guarded(self, operation: str, raw_limits: dict | None, returns: dict | None, work) -> dict:
        try:
            limits = Limits.of(raw_limits, returns, self.enforce)
        except PlanError as e:
            return e.envelope(operation)
        return self._within(limits, operation, lambda: work(limits))

    # ------------------------------------------------------------ verbs

    def inspect(self, source: dict, sample_rows: int = 5, target_schema: dict | None = None, mappings: dict | None = None, limits: dict | None = None) -> dict:
        def work(lim):
            if not (mappings is None or target_schema is not None):
                raise PlanError("E_REQUEST_INVALID", "mappings need a target schema")
            spec = model.checked(model.source, source, "the source is invalid")
            data = load(self.spark, spec, lim, self.root)
            self._counted(lim, data)
            if data.kind == "table":
                shape, sample = profile.table_shape(data.frame), profile.table_sample(data.frame, sample_rows)
            else:
                shape, sample = profile.tree_shape(data.value), profile.tree_sample(data.value) if sample_rows else None
            out = {"status": "ok", "operation": "inspect", "source": {"format": data.format, "bytes": data.bytes}, "shape": shape, "sample": sample}
            if target_schema is not None:
                checks.checked_schema(target_schema)
                out["adaptation"] = adapter.adapt(shape, target_schema, mappings, spec)
            return out

        return self._guarded("inspect", limits, None, work)

    def _effects(self, steps: list[Step], data: dict[str, Data], figures: dict[str, dict], full: bool) -> list[dict]:
        n = lambda name: figures[name]["n"]
        out = []
        for s in steps:
            e: dict = {"id": s.id, "op": s.op}
            if s.data.kind == "tree":
                e |= trees.changes(data[s.inputs[0]].value, s.data.value)
                warnings = [{"code": "W_TREE_PATHS_REMOVED", "paths": e["removed"][:_EFFECT_CAP], "total": len(e["removed"])}] if e["removed"] else []
            else:
                before, after = data[s.inputs[0]].frame, s.data.frame
                e |= {"fields_added": [c for c in after.columns if c not in before.columns], "fields_removed": [c for c in before.columns if c not in after.columns]}
                e["type_changes"] = [{"field": c, "from": exact(before, c).simpleString(), "to": exact(after, c).simpleString()} for c in after.columns if c in before.columns and exact(before, c) != exact(after, c)]
                warnings = [w for w in after.warnings if w not in before.warnings] if s.op != "join" else []
                if full:
                    e |= {"rows_in": n(s.inputs[0]), "rows_out": n(s.id)}
                    e["rows_delta"] = e["rows_out"] - e["rows_in"]
                    if s.op == "dedupe" and e["rows_delta"]:
                        warnings.append({"code": "W_ROWS_DEDUPED", "rows": -e["rows_delta"]})
                    if s.op == "explode":
                        empty = figures[f"in:{s.id}"]["empty"]
                        warnings += [{"code": "W_EXPLODE_EMPTY", "rows": empty}] if empty else []
                    if s.op == "cast":
                        warnings += [{"code": "W_LOSSY_CAST", "field": f, "rows": k} for f, k in figures.get(f"in:{s.id}", {}).items() if k]
                    if s.op == "join":
                        right = data[s.inputs[1]].frame
                        m = groups.join_effects(before, right, s.spec).first().asDict()
                        e["join"] = m
                        warnings += [{"code": "W_JOIN_UNMATCHED", "left": m["left_unmatched"], "right": m["right_unmatched"]}] if m["left_unmatched"] or m["right_unmatched"] else []
                        warnings += [{"code": "W_JOIN_FANOUT", "rows": m["left_fanout"]}] if m["left_fanout"] else []
                        lost = {"left": m["left_unmatched"], "right": m["right_unmatched"], "full": m["left_unmatched"] + m["right_unmatched"]}.get(s.spec.get("type", "inner"), 0)
                        warnings += [{"code": "W_NULLS_INTRODUCED", "rows": lost}] if lost else []
            e["warnings"] = warnings
            out.append(_capped(e))
        return out

    def transform(self, plan: dict, dry_run: bool | None = None, effects: str = "full") -> dict:
        raw = plan if isinstance(plan, dict) else {}
        returns = raw.get("return") if isinstance(raw.get("return"), dict) else {}

        def work(limits):
            spec = model.plan(plan)
            dry = spec.get("dry_run", False) if dry_run is None else dry_run
            mode = spec.get("return", {}).get("mode", "auto")
            target = sinks.planned(spec["output"], self.root) if "output" in spec else None
            if not (mode != "reference" or target is not None):
                raise PlanError("E_OUTPUT_REQUIRED", "return mode reference needs an output")
            data, steps = self.run_steps(spec, limits)
            last = steps[-1].data
            full, table = effects == "full", last.kind == "table"
            figures: dict[str, dict] = {}
            if full or self.strict:
                try:
                    figures = self._measured(data, steps, list(spec["sources"]), full)
                except Exception:
                    self._blamed(steps)
                    raise
            most = max((f.get("n", 0) for f in figures.values()), default=0)
            if not (not limits.enforce or most <= limits.max_rows):
                raise PlanError("E_ROW_LIMIT", "a table exceeds the row budget", {"rows": most})
            self._held(limits, data, steps, list(spec["sources"]), figures)
            if "schema" in spec:
                found = checks.validate_schema(last.kind, last.frame, last.value, spec["schema"])
                if not (found["valid"]):
                    raise PlanError("E_SCHEMA_FAILED", "the result does not meet the schema", {"failures": found["failures"]})
            if spec.get("assert"):
                found = checks.on_table(last.frame, spec["assert"]) if last.kind == "table" else checks.on_tree(last.value, spec["assert"])
                bad = [a for a in found if not a["passed"]]
                if bad:
                    raise PlanError("E_ASSERTION_FAILED", "assertions failed", {"failures": bad})
            audit = {"steps": self._effects(steps, data, figures, full)}
            n = (figures[steps[-1].id]["n"] if full else last.frame.df.count()) if table else None
            if not (n is None or not limits.enforce or n <= limits.max_rows):
                raise PlanError("E_ROW_LIMIT", "a table exceeds the row budget", {"rows": n})
            sample = profile.table_sample(last.frame, limits.sample_rows) if table else profile.tree_sample(last.value)
            result: dict = {"kind": "summary"}
            if target is not None:
                sinks.feasible(last.kind, last.frame, target[1])
            if not dry:
                if target is not None:
                    result = {"kind": "file", **sinks.publish(last.kind, last.frame, last.value, *target, spec["output"].get("overwrite", False))}
                elif mode in ("auto", "inline"):
                    values = [{c: public(r[c]) for c in last.frame.columns} for r in last.frame.sorted.limit(100_000).collect()] if table and n <= 100_000 else public(last.value) if not table else None
                    size = len(canonical(values).encode()) if values is not None else limits.max_inline_bytes + 1
                    if size <= limits.max_inline_bytes:
                        result = {"kind": "inline", "data": values}
                    else:
                        if mode != "auto":
                            raise PlanError("E_OUTPUT_TOO_LARGE", "the result exceeds the inline budget", {"bytes": size})
            if full:
                audit["result_sha256"] = sinks.rows_digest(last.frame) if table else hashlib.sha256(canonical(last.value).encode() + b"\n").hexdigest()
            audit["warnings"] = [w for s in audit["steps"] for w in s["warnings"]]
            summary = {"sources": len(spec["sources"]), "rows_in": sum(figures[s]["n"] for s in spec["sources"] if data[s].kind == "table") if full else None, "rows_out": n, "columns_out": len(last.frame.columns) if table else None}
            return {"status": "dry_run" if dry else "ok", "operation": "transform", "result": result, "summary": summary, "sample": sample, "execution_effects": audit}

        return self._guarded("transform", raw.get("limits") if isinstance(raw.get("limits"), dict) else None, returns, work)

    def validate(self, source: dict, schema: dict | None = None, assertions: list[dict] | None = None, sample_rows: int = 5, limits: dict | None = None) -> dict:
        def work(lim):
            if not (schema is not None or bool(assertions)):
                raise PlanError("E_VALIDATION_REQUIRED", "a schema or assertions are needed")
            wanted = model.checked(model.many(model.assertion), assertions or [], "assertions are invalid")
            data = load(self.spark, model.checked(model.source, source, "the source is invalid"), lim, self.root)
            self._counted(lim, data)
            table = data.kind == "table"
            by_schema = checks.validate_schema(data.kind, data.frame, data.value, schema) if schema is not None else None
            found = checks.on_table(data.frame, wanted) if table else checks.on_tree(data.value, wanted)
            shape = profile.table_shape(data.frame, False) if table else profile.tree_shape(data.value)
            sample = profile.table_sample(data.frame, sample_rows) if table else profile.tree_sample(data.value)
            valid = (by_schema is None or by_schema["valid"]) and all(a["passed"] for a in found)
            return {"status": "ok", "operation": "validate", "valid": valid, "shape": shape, "schema_validation": by_schema, "assertions": found, "sample": sample}

        return self._guarded("validate", limits, None, work)

    def diff(self, left: dict, right: dict, key_fields: list[str] | None = None, sample_rows: int = 5, limits: dict | None = None) -> dict:
        def work(lim):
            a, b = (load(self.spark, model.checked(model.source, s, "the source is invalid"), lim, self.root) for s in (left, right))
            self._counted(lim, a, b)
            out = {"status": "ok", "operation": "diff"}
            if a.kind != b.kind:
                return out | {"identical": False, "kind_change": {"left": a.kind, "right": b.kind}, "row_comparison": "not_comparable"}
            if a.kind == "tree":
                if key_fields:
                    raise PlanError("E_DIFF_KEY_INVALID", "trees have no keys")
                return out | differ.trees(a.value, b.value, sample_rows)
            if not (key_fields is None or (bool(key_fields) and len(set(key_fields)) == len(key_fields))):
                raise PlanError("E_DIFF_KEY_INVALID", "keys must be given once each")
            return out | differ.tables(a.frame, b.frame, key_fields, sample_rows)

        return self._guarded("diff", limits, None, work)


def value_frame(spark: SparkSession, value) -> Frame:
    """Inline rows as a frame."""
    return promoted(spark, value, "table").frame
