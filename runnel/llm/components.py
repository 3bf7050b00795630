"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runnel.llm.common import discard_table, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    met = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return met.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of an edge (a, b); the component is its least reachable id.

    Edges with a null end, and loops, are left out; repeated edges count once. Each round is
    written to the shared folder, and rounds go on until one changes nothing, so a chain of n
    links takes about log n rounds. No links at all give an empty table.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        new = written(_star(_star(now, True), False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        seen = new.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard_table(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
