"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one shuffle of the edges and is written to the shared folder, so no
links or components ever come together on one machine, and a lost executor costs
at most a step.  A hub keeps its neighbours in separate rows throughout, dealt out
over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, materialise, with_totals

MAX_STEPS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = with_totals(both, ["a"], "b", m=("b", F.min)).withColumn("m", F.least("a", "m"))
    return least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = with_totals(down, ["a"], "b", m=("b", F.min))
    return least.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge (a, b) but the smallest ones themselves."""
    now, before = materialise(edges.select("a", "b").filter("a != b").distinct(), "edges"), None
    for _ in range(MAX_STEPS):
        old, now = now, materialise(_small(_large(now)), "edges")
        discard(old)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = mark
    raise RuntimeError("components did not settle")
