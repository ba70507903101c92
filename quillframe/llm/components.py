"""Connected components by alternating large-star and small-star steps; no step gathers a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialise


def _marks(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Each edge's smaller end gives way to its own smallest neighbour. Only nodes that have a smaller one are written and
    joined, fewer every round: a root with very many edges keeps them as they are, and its rows can be split."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("v"), "m"), name)
    return edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for each node of ``edges(u, v)`` that is not its component's smallest; empty for no edges.

    The number of rounds grows with the logarithm of a component's size; each round is written to the shared
    folder, which cuts the lineage.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    marks = _marks(now)
    while marks[0]:
        after = materialise(_small_star(_large_star(now, name)), name)
        found = _marks(after)
        now, same, marks = after, found == marks, found
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
