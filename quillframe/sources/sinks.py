"""Sinks. ``directory`` writes as Spark does, in parallel; ``single file`` keeps the one-file promise, staged beside its
target and published at once."""

from __future__ import annotations

import csv
import hashlib
import io
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import Frame, quoted
from quillframe.sources.readers import confined, format_of
from quillframe.sources.values import canonical, dumps, public


def planned(spec: dict, root: str | None) -> tuple[Path, str]:
    """Checks before any work: the folder exists, the target is a file, and overwriting was asked for."""
    path = confined(spec["path"], root)
    carrier = format_of(str(path), spec.get("format"))
    if not path.parent.is_dir():
        raise PlanError("E_OUTPUT_DIRECTORY", "the output's folder does not exist", {"path": str(path.parent)})
    if not (not path.is_dir() and not path.is_symlink()):
        raise PlanError("E_OUTPUT_INVALID", "the output is not a regular file")
    if not (spec.get("overwrite", False) or not path.exists()):
        raise PlanError("E_OUTPUT_EXISTS", "the output exists", {"path": spec["path"]})
    return path, carrier


def feasible(kind: str, frame: Frame | None, carrier: str) -> None:
    if kind == "tree":
        if carrier not in ("json", "yaml"):
            raise PlanError("E_OUTPUT_INVALID", f"a tree cannot be written as {carrier}")
        return
    if not frame.columns:
        if carrier in ("parquet", "csv", "tsv"):
            raise PlanError("E_OUTPUT_EMPTY_SCHEMA", f"a table without columns cannot be written as {carrier}")
    elif carrier in ("json", "jsonl", "yaml"):
        if frame.visible.isEmpty():
            raise PlanError("E_OUTPUT_SCHEMA_LOSS", f"an empty table would lose its columns in {carrier}")


def _cell(v) -> str:
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return "true" if v else "false"
    v = public(v)
    text = v if isinstance(v, str) else dumps(v)
    return "\\" + text if text.startswith("\\") else text


def _yaml(value) -> str:
    import yaml

    class Plain(yaml.SafeDumper):
        pass

    from decimal import Decimal

    Plain.add_representer(Decimal, lambda d, v: d.represent_scalar("tag:yaml.org,2002:float" if v != v.to_integral_value() or v.as_tuple().exponent < 0 else "tag:yaml.org,2002:int", format(v, "f")))
    return yaml.dump(value, Dumper=Plain, allow_unicode=True, sort_keys=False)


def _row(r) -> dict:
    return {k: (v.asDict(recursive=True) if hasattr(v, "asDict") else v) for k, v in r.asDict().items()}


def _write_rows(frame: Frame, carrier: str, to: Path) -> None:
    rows = frame.sorted.toLocalIterator(prefetchPartitions=True)
    with to.open("w", encoding="utf-8", newline="") as f:
        if carrier == "json":
            f.write("[")
            for i, r in enumerate(rows):
                f.write((",\n" if i else "\n") + dumps(_row(r)))
            f.write("\n]\n")
        elif carrier == "jsonl":
            for r in rows:
                f.write(dumps(_row(r)) + "\n")
        elif carrier == "yaml":
            wrote = False
            for r in rows:
                f.write(_yaml([_row(r)]))
                wrote = True
            if not wrote:
                f.write("[]\n")
        else:
            out = csv.writer(f, delimiter="," if carrier == "csv" else "\t", lineterminator="\n")
            out.writerow(frame.columns)
            for r in rows:
                out.writerow([_cell(v) for v in r])


#: The row digest's prime modulus, and a base below it.
_PRIME = (1 << 255) - 19
_BASE = int.from_bytes(hashlib.sha256(b"rows in order").digest()) % _PRIME


def rows_digest(frame: Frame) -> str:
    """A digest of the rows in their order, whatever the partitions: rows' SHA-256 values are the digits of a number in
    base ``_BASE`` modulo a prime. Each partition gives one such number, and the driver appends them to each other."""
    names = frame.columns

    def part(rows):
        n, value = 0, 0
        for r in rows:
            line = canonical({c: r[c] for c in names}).encode()
            n, value = n + 1, (value * _BASE + int.from_bytes(hashlib.sha256(line).digest())) % _PRIME
        yield n, value

    total, whole = 0, 0
    for n, value in frame.sorted.rdd.mapPartitions(part).collect():
        total, whole = total + n, (whole * pow(_BASE, n, _PRIME) + value) % _PRIME
    return hashlib.sha256(f"{total} {whole}".encode()).hexdigest()


def digest(path: Path) -> dict:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return {"bytes": path.stat().st_size, "sha256": h.hexdigest()}


def publish(kind: str, frame: Frame | None, value, path: Path, carrier: str, overwrite: bool) -> dict:
    """Write beside the target, then replace it, or link so that of two writers one wins."""
    feasible(kind, frame, carrier)
    staged = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        if kind == "tree":
            staged.write_text((dumps(value, indent=2) + "\n") if carrier == "json" else _yaml(value), encoding="utf-8")
        elif carrier == "parquet":
            folder = staged.with_name(staged.name + ".parts")
            try:
                frame.sorted.coalesce(1).write.parquet(str(folder))
                os.replace(next(folder.glob("part-*.parquet")), staged)
            finally:
                shutil.rmtree(folder, ignore_errors=True)
        else:
            _write_rows(frame, carrier, staged)
        if overwrite:
            os.replace(staged, path)
        else:
            try:
                os.link(staged, path)
            except FileExistsError:
                raise PlanError("E_OUTPUT_EXISTS", "the output exists", {"path": str(path)}) from None
    except OSError as e:
        raise PlanError("E_IO", str(e)) from None
    finally:
        staged.unlink(missing_ok=True)
    return {"path": str(path), "format": carrier, **digest(path)}


def write_directory(frame: Frame, uri: str, carrier: str, ordered: bool = True) -> None:
    """A directory of part files; rows are in order over the files' names."""
    df = frame.sorted if ordered else frame.visible
    if carrier == "parquet":
        df.write.parquet(uri)
        return
    if carrier == "jsonl":
        plain = [quoted(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else quoted(f.name) for f in df.schema.fields]
        df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("value")).write.text(uri)
        return
    if carrier not in ("csv", "tsv"):
        raise PlanError("E_FORMAT_UNSUPPORTED", f"{carrier} is written as one file only")
    cells = []
    for f in df.schema.fields:
        c = quoted(f.name).cast("string") if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(quoted(f.name))
        cells.append(F.when(c.isNull(), "\\N").when(c.startswith("\\"), F.concat(F.lit("\\"), c)).otherwise(c).alias(f.name))
    df.select(*cells).write.option("header", True).option("sep", "," if carrier == "csv" else "\t").option("escape", '"').option("emptyValue", "").csv(uri)


def rows_text(rows: list[dict]) -> str:
    out = io.StringIO()
    for r in rows:
        out.write(dumps(r) + "\n")
    return out.getvalue()
