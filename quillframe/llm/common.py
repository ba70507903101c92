"""Shared plumbing of the corpus operators: durable intermediate tables, sizing and vectorised hashing."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}

#: Odd 64-bit multipliers (fractional parts of irrational constants), used by every mixing step below.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a private one only in a local session that names none (tests); on
    a cluster that is an error, since executors do not share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="quillframe-")
            spark.sparkContext.setCheckpointDir(_FALLBACK[app])
        found = _FALLBACK[app]
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, the figure from which partition counts follow."""
    found = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()
    return int(found["b"] or 0)


def parts_for(spark: SparkSession, total_bytes: int, per_part: int) -> int:
    """Partitions of about ``per_part`` bytes each, at least the session's default parallelism for shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / per_part))


def with_sums_before(df: DataFrame, by: list[str], group: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with column ``name``: the sum of ``value`` over the rows before each in ``order``, for each key ``by``.

    ``group`` cuts that order into runs and rises with it. Runs are summed first and prefix sums taken over them, so that
    no task sorts a whole key: one holds a run, or one row for each run of a key. Null keys are a key of their own.
    """
    cut = df.withColumn("__qf_run", group)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy(*by, "__qf_run").agg(F.sum(value).alias("__qf_sum"))
    runs = runs.withColumn("__qf_base", F.coalesce(F.sum("__qf_sum").over(earlier(Window.partitionBy(*by).orderBy("__qf_run"))), F.lit(0))).drop("__qf_sum")
    inside = earlier(Window.partitionBy(*by, "__qf_run").orderBy(*order))
    cut = cut.withColumn("__qf_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    keys = [*by, "__qf_run"]
    runs = runs.select(*[F.col(c).alias(f"__qf_k{i}") for i, c in enumerate(keys)], "__qf_base")
    joined = cut.join(runs, [F.col(c).eqNullSafe(F.col(f"__qf_k{i}")) for i, c in enumerate(keys)])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__qf_base") + F.col("__qf_inside")).cast("long").alias(name))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names would clash (case-insensitively) with what an operator adds."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_B
    x ^= x >> np.uint64(27)
    x *= MIX_C
    x ^= x >> np.uint64(31)
    return x


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and n+1 offsets of an Arrow string/binary column, without copying; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]
