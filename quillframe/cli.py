"""Command line: inspect, transform, validate, diff; also a loop over JSON requests, one a line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quillframe.errors import PlanError
from quillframe.plans.engine import Engine
from quillframe.sources.readers import format_of
from quillframe.sources.values import parse_json, parse_yaml, public


def _document(name: str):
    raw = sys.stdin.read() if name == "-" else Path(name).read_text(encoding="utf-8")
    return parse_yaml(raw) if name != "-" and format_of(name, None) == "yaml" else parse_json(raw)


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("quillframe").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def serve(engine: Engine, lines, out) -> None:
    """``{"operation": ..., ...}`` per line; inspect and validate only, as requests come from other programs."""
    for line in lines:
        if not line.strip():
            continue
        try:
            if len(line.encode()) > 64 << 10:
                raise PlanError("E_REQUEST_INVALID", "a request line is too long")
            request = parse_json(line)
            verb = request.pop("operation", None) if isinstance(request, dict) else None
            if verb not in ("inspect", "validate"):
                raise PlanError("E_REQUEST_INVALID", "the operation must be inspect or validate")
            answer = getattr(engine, verb)(**request)
        except PlanError as e:
            answer = e.envelope()
        except TypeError as e:
            answer = PlanError("E_REQUEST_INVALID", str(e)).envelope()
        out.write(json.dumps(public(answer), ensure_ascii=False) + "\n")
        out.flush()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillframe", description=__doc__)
    parser.add_argument("--workspace", help="folder that paths may not leave")
    parser.add_argument("--compact", action="store_true")
    verbs = parser.add_subparsers(dest="verb", required=True)
    p = verbs.add_parser("inspect")
    p.add_argument("path")
    p.add_argument("--format")
    p.add_argument("--select")
    p = verbs.add_parser("transform")
    p.add_argument("plan", help="JSON or YAML file, - for standard input")
    p.add_argument("--dry-run", action="store_true", default=None)
    p = verbs.add_parser("validate")
    p.add_argument("path")
    p.add_argument("--schema")
    p.add_argument("--assertions")
    p = verbs.add_parser("diff")
    p.add_argument("left")
    p.add_argument("right")
    p.add_argument("--key", action="append")
    verbs.add_parser("serve")
    args = parser.parse_args(argv)
    try:
        engine = Engine(_session(), root=args.workspace)
        if args.verb == "serve":
            serve(engine, sys.stdin, sys.stdout)
            return 0
        if args.verb == "inspect":
            out = engine.inspect({k: v for k, v in (("path", args.path), ("format", args.format), ("select", args.select)) if v})
        elif args.verb == "transform":
            out = engine.transform(_document(args.plan), dry_run=args.dry_run)
        elif args.verb == "validate":
            out = engine.validate({"path": args.path}, _document(args.schema) if args.schema else None, _document(args.assertions) if args.assertions else None)
        else:
            out = engine.diff({"path": args.left}, {"path": args.right}, args.key)
    except PlanError as e:
        out = e.envelope(args.verb)
    except OSError as e:
        out = PlanError("E_CLI_INPUT", str(e)).envelope(args.verb)
    print(json.dumps(public(out), ensure_ascii=False, indent=None if args.compact else 2))
    return 0 if out["status"] != "error" else 2


if __name__ == "__main__":
    sys.exit(main())
