"""Where the catalogue's modules put their queries, and the scratch folder of round trips."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def code(name: str, sql: str | None):
    """Register the decorated query, and its SQL if it has one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def folder(spark: SparkSession) -> str:
    """A fresh folder all executors see; the temporary folder only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/roundtrip-{uuid.uuid4().hex}"
