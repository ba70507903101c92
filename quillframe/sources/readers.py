"""Sources: JSON, JSONL, CSV, TSV, YAML, Parquet and inline values.

Parquet is read natively and ordered by file and row number. JSONL and delimited text are read as lines, several tasks to
a file, and ordered by file, block and place in it; delimited text with line breaks inside of cells (or with bytes that are
not UTF-8) is parsed file by file. JSON and YAML are one value by nature and are parsed on the driver under the input budget.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import PlanError
from quillframe.frame import HIDDEN, Frame, Key, hidden, quoted
from quillframe.functions.kinds import normalised
from quillframe.limits import Limits, items_of
from quillframe.sources.selectors import selected
from quillframe.sources.values import Kind, coerced, parse_json, parse_yaml

_SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "tsv", ".yaml": "yaml", ".yml": "yaml", ".parquet": "parquet"}


@dataclass(frozen=True)
class Data:
    """What a name in a plan stands for: a table (a frame) or a tree (one value)."""

    kind: str
    frame: Frame | None = None
    value: object = None
    format: str = "inline"
    bytes: int = 0
    items: int | None = None  # of JSON, YAML and inline values, known once parsed


def format_of(path: str, given: str | None) -> str:
    found = given or _SUFFIXES.get(Path(path).suffix.lower())
    if not found:
        raise PlanError("E_FORMAT_REQUIRED", f"the format of {path!r} is not clear from its name")
    return found


def confined(path: str, root: str | None) -> Path:
    """A local path inside the workspace, symbolic links followed."""
    if not ("://" not in path and not path.startswith("\\\\")):
        raise PlanError("E_NETWORK_FORBIDDEN", "only local paths are read", {"path": path})
    if not ("\x00" not in path and bool(path)):
        raise PlanError("E_PATH_INVALID", "the path is not valid")
    p = Path(path)
    if root is None:
        return p
    base = Path(root).resolve()
    full = (p if p.is_absolute() else base / p).resolve()
    if not (full == base or base in full.parents):
        raise PlanError("E_PATH_OUTSIDE_WORKSPACE", "the path leaves the workspace", {"path": path})
    return full


def _depth(v, most: int, at: int = 1) -> None:
    if at > most:
        raise PlanError("E_DEPTH_LIMIT", "the value is nested too deeply", {"maximum": most})
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        if isinstance(x, (dict, list)):
            _depth(x, most, at + 1)


def table_of(spark: SparkSession, rows: list[dict], kinds: dict[str, Kind] | None = None) -> Frame:
    """Inline rows: types by the lattice, rows in their order."""
    kind = Kind("object", fields={})
    for r in rows:
        kind = kind.merged(Kind.of(r), "$")
    schema = T.StructType([T.StructField(k, v.spark()) for k, v in (kinds or kind.fields).items()])
    for name in schema.names:
        if name.startswith(HIDDEN):
            raise PlanError("E_RESERVED_FIELD", f"names starting with {HIDDEN} are reserved", {"field": name})
    low = [n.lower() for n in schema.names]
    if len(set(low)) != len(low):
        raise PlanError("E_DUPLICATE_FIELD", "field names differ in case only")
    at = hidden()
    data = [(*coerced(r, schema), i) for i, r in enumerate(rows)]
    return Frame(spark.createDataFrame(data, T.StructType([*schema.fields, T.StructField(at, T.LongType())])), (Key(at),))


def promoted(spark: SparkSession, value, kind: str | None) -> Data:
    """A list of objects is a table; ``kind`` forces either form."""
    if kind != "tree" and isinstance(value, list) and all(isinstance(x, dict) for x in value):
        return Data("table", table_of(spark, value))
    if kind == "table":
        rows = value if isinstance(value, list) else [value]
        return Data("table", table_of(spark, [x if isinstance(x, dict) else {"value": x} for x in rows]))
    return Data("tree", value=value)


def parquet(spark: SparkSession, path: str) -> Frame:
    df = spark.read.parquet(path)
    for name in df.columns:
        if name.startswith(HIDDEN):
            raise PlanError("E_RESERVED_FIELD", f"names starting with {HIDDEN} are reserved", {"field": name})
    f, r = hidden(), hidden()
    return Frame(df.select(*[quoted(c) for c in df.columns], F.col("_metadata.file_path").alias(f), F.col("_metadata.row_index").alias(r)), (Key(f), Key(r)))


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[Key, Key, Key]]:
    """``line`` and its order: the file, the block of the file that a task read it from, and its place in that task."""
    keys = tuple(Key(hidden()) for _ in range(3))
    order = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.text(path).select(F.col("value").alias("line"), *[c.alias(k.name) for c, k in zip(order, keys, strict=True)]), keys


def _census(lines: DataFrame) -> Kind:
    """Types of a column of JSON lines, merged per partition and then on the driver: one small row a partition."""

    def part(rows):
        import pickle

        kind = Kind("null")
        for r in rows:
            v = parse_json(r[0])
            if not isinstance(v, dict):
                raise PlanError("E_TYPE_MISMATCH", "each line must be an object")
            kind = kind.merged(Kind.of(v), "$")
        yield pickle.dumps(_spelled(kind))

    import pickle

    out = Kind("null")
    for blob in lines.rdd.map(lambda r: (r[0],)).mapPartitions(part).collect():
        out = out.merged(_respelled(pickle.loads(blob)), "$")
    return out


def _spelled(k: Kind):
    return (k.name, k.whole, k.scale, None if k.fields is None else {n: _spelled(x) for n, x in k.fields.items()}, None if k.element is None else _spelled(k.element))


def _respelled(t) -> Kind:
    return Kind(t[0], t[1], t[2], None if t[3] is None else {n: _respelled(x) for n, x in t[3].items()}, None if t[4] is None else _respelled(t[4]))


def jsonl(spark: SparkSession, path: str) -> Frame:
    lines, keys = _lines(spark, path)
    lines = lines.where(F.trim("line") != "")
    kind = _census(lines.select("line"))
    if kind.name == "null":
        return table_of(spark, [])
    schema = T.StructType([T.StructField(k, v.spark()) for k, v in kind.fields.items()])
    row, names = F.from_json("line", schema, {"mode": "FAILFAST"}), [k.name for k in keys]
    return Frame(lines.select(row.alias("r"), *names).select("r.*", *names), keys)


def _cell_kinds(values: DataFrame, names: list[str]) -> dict[str, str]:
    """One aggregate types every column: all integers, all fractions, all true/false, else text."""
    checks = []
    for i, n in enumerate(names):
        c = quoted(n)
        tests = {"int": c.rlike(r"^-?(0|[1-9]\d*)$"), "dec": c.rlike(r"^-?(0|[1-9]\d*)(\.\d+([eE][+-]?\d+)?|[eE][+-]?\d+)$"), "bool": c.isin("true", "false")}
        filled = c.isNotNull() & (c != "")
        checks += [F.coalesce(F.bool_and(F.when(filled, t)), F.lit(False)).alias(f"{k}{i}") for k, t in tests.items()]
        checks += [F.count_if(c == "").alias(f"empty{i}"), F.max(F.length(F.regexp_replace(c, r"^-|\..*$", ""))).alias(f"whole{i}"), F.max(F.length(F.regexp_extract(c, r"\.(\d+)", 1))).alias(f"scale{i}"), F.bool_or(c.rlike("[eE]")).alias(f"exp{i}")]
    row = values.agg(*checks).first() if names else {}
    out = {}
    for i, n in enumerate(names):
        typed = "int" if row[f"int{i}"] else "dec" if row[f"dec{i}"] else "bool" if row[f"bool{i}"] else None
        if typed and row[f"empty{i}"]:
            raise PlanError("E_TYPE_MISMATCH", f"column {n!r} mixes empty text and typed values", {"field": n})
        if typed == "int":
            out[n] = "bigint" if row[f"whole{i}"] <= 18 else f"decimal({row[f'whole{i}']},0)"
        elif typed == "dec":
            out[n] = "decimal(38,18)" if row[f"exp{i}"] else f"decimal({row[f'whole{i}'] + row[f'scale{i}']},{row[f'scale{i}']})"
        else:
            out[n] = "boolean" if typed == "bool" else "string"
    return out


def _cells(rows, width: int):
    for r in rows:
        if len(r) != width:
            raise PlanError("E_PARSE", f"a row has {len(r)} cells, the header {width}")
        yield [None if x == "\\N" else x[1:] if x.startswith("\\\\") else x for x in r]


def _by_line(lines: DataFrame, keys: tuple[Key, ...], header: list[str], sep: str) -> DataFrame:
    """Rows of text whose every line is a row; each file's first filled line is its header."""
    kept = [k.name for k in keys]
    schema = T.StructType([*[T.StructField(h, T.StringType()) for h in header], *[lines.schema[k] for k in kept]])

    def parse(batches):
        import pyarrow as pa

        opened = set()
        for batch in batches:
            at, texts = [], []
            for i, (line, file, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if block == 0 and file not in opened and line:
                    opened.add(file)
                elif line:
                    at.append(i)
                    texts.append(line)
            columns = list(zip(*_cells(csv.reader(texts, delimiter=sep, strict=True), len(header)), strict=True)) or [()] * len(header)
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], *[own.column(1 + i) for i in range(len(kept))]], names=schema.names)

    return lines.mapInArrow(parse, schema)


def delimited(spark: SparkSession, path: str, sep: str) -> Frame:
    r"""Strict delimited text: a unique header, exact widths, ``\N`` is null, a leading ``\\`` is one backslash."""
    with open(path, newline="", encoding="utf-8-sig") as f:
        reader = csv.reader(f, delimiter=sep, strict=True)
        header = next(reader, None)
    if not (bool(header) and all(header)):
        raise PlanError("E_PARSE", "a header with a name for each column is needed")
    if len({h.lower() for h in header}) != len(header):
        raise PlanError("E_DUPLICATE_FIELD", "header names are not unique")

    def parse(pairs):
        for name, content in pairs:
            rows = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""), delimiter=sep, strict=True)
            next(rows, None)
            for i, r in enumerate(_cells((r for r in rows if r), len(header))):
                yield (*r, name, i)

    lines, keys = _lines(spark, path)
    # a cell with a line break leaves an odd number of quotes on a line
    whole = lines.where((F.length("line") - F.length(F.translate("line", '"', ""))) % 2 == 1).union(lines.where(F.contains("line", F.lit("\ufffd")))).limit(1).count()
    if whole:
        keys = keys[:2]
        schema = T.StructType([*[T.StructField(h, T.StringType()) for h in header], T.StructField(keys[0].name, T.StringType()), T.StructField(keys[1].name, T.LongType())])
        raw = spark.createDataFrame(spark.read.format("binaryFile").load(path).select("path", "content").rdd.map(tuple).mapPartitions(parse), schema)
    else:
        raw = _by_line(lines, keys, header, sep)
    kinds = _cell_kinds(raw, header)
    return Frame(raw.select(*[quoted(h).cast(kinds[h]).alias(h) for h in header], *[k.name for k in keys]), keys)


def _budgeted(data: Data, value, limits: Limits) -> Data:
    items = items_of(value)
    limits.hold(items, "the source")
    return replace(data, items=items)


def load(spark: SparkSession, spec: dict, limits: Limits, root: str | None = None) -> Data:
    """A checked source. Selectors apply to JSON, YAML and inline values only."""
    select, kind = spec.get("select"), spec.get("kind")
    if "inline" in spec:
        value = spec["inline"]
        if isinstance(value, str) and spec.get("format") in ("json", "yaml"):
            value = parse_json(value) if spec["format"] == "json" else parse_yaml(value)
        value = normalised(value)
        _depth(value, limits.max_depth)
        return _budgeted(promoted(spark, value := selected(value, select) if select else value, kind), value, limits)
    path = confined(spec["path"], root)
    carrier = format_of(str(path), spec.get("format"))
    if carrier == "parquet" and path.is_dir():
        size = sum(f.stat().st_size for f in path.rglob("*.parquet"))
    else:
        if not path.is_file():
            raise PlanError("E_SOURCE_NOT_FOUND", f"no file at {spec['path']!r}", {"path": spec["path"]})
        size = path.stat().st_size
    if not (not limits.enforce or size <= limits.max_input_bytes):
        raise PlanError("E_INPUT_TOO_LARGE", "the source exceeds the input budget", {"bytes": size})
    if carrier in ("json", "yaml"):
        raw = path.read_text(encoding="utf-8-sig")
        value = parse_json(raw) if carrier == "json" else parse_yaml(raw)
        _depth(value, limits.max_depth)
        data = _budgeted(promoted(spark, value := selected(value, select) if select else value, kind), value, limits)
        return replace(data, format=carrier, bytes=size)
    if select is not None:
        raise PlanError("E_SOURCE_INVALID", f"{carrier} sources take no selector")
    if kind == "tree":
        raise PlanError("E_SOURCE_INVALID", f"{carrier} sources are tables")
    frame = parquet(spark, str(path)) if carrier == "parquet" else jsonl(spark, str(path)) if carrier == "jsonl" else delimited(spark, str(path), "," if carrier == "csv" else "\t")
    return Data("table", frame, None, carrier, size)
