"""Range, interval and temporal joins, as equi-joins on buckets with a residual filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_pairs(grid: DataFrame, points: DataFrame, reach: float, how: str = "left") -> DataFrame:
    """Grid rows (recording_id, t) with the points (recording_id, t, ...) at most ``reach`` away, ends included.

    Points fall into buckets as wide as the window; a grid row meets the two or three buckets its
    window touches, so each bucket is small and no pair outside neighbouring ones is formed.
    """
    width = 2.0 * reach
    b = points.withColumnRenamed("t", "b_t").withColumn("_k", F.floor(F.col("b_t") / width))
    g = grid.withColumn("_k", F.explode(F.sequence(F.floor((F.col("t") - reach) / width), F.floor((F.col("t") + reach) / width))))
    near = (F.col("b_t") >= F.col("t") - reach) & (F.col("b_t") <= F.col("t") + reach)
    found = g.join(b, ["recording_id", "_k"]).where(near).drop("_k")
    if how == "inner":
        return found
    return grid.join(found, grid.columns, "left")


def range_count(grid: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """Adds ``n``, the number of points in the window of each grid row."""
    return range_pairs(grid, points, reach).groupBy("recording_id", "t").agg(F.count("b_t").alias("n"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str = "t", width: float = 64.0) -> DataFrame:
    """Points (recording_id, at) in closed intervals (recording_id, start, stop), by buckets of ``width``."""
    p = points.withColumn("_k", F.floor(F.col(at) / width))
    i = intervals.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    return p.join(i, ["recording_id", "_k"]).where(F.col(at).between(F.col("start"), F.col("stop"))).drop("_k")


def together(nodes: DataFrame) -> DataFrame:
    """(a, b, frame_idx): pairs of different tracks with a node in the same frame of a recording."""
    n = nodes.select("recording_id", "frame_idx", "track_id").distinct()
    other = n.withColumnRenamed("track_id", "b")
    return n.withColumnRenamed("track_id", "a").join(other, ["recording_id", "frame_idx"]).where("a <> b")


def linked(nodes: DataFrame, more_than: int = 3) -> DataFrame:
    """Pairs of tracks that share more than so many frames."""
    return together(nodes).groupBy("recording_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of equal position within a recording; the shorter side decides."""
    number = lambda d, o: d.withColumn("_p", F.row_number().over(Window.partitionBy("recording_id").orderBy(o)))
    return number(left, left_order).join(number(right, right_order), ["recording_id", "_p"]).withColumn("position", (F.col("_p") - 1).cast("long")).drop("_p")


def successors(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Each row with its successor's value; the last two rows of a recording have none."""
    w = Window.partitionBy("recording_id").orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    return df.withColumn(out, F.lead(value).over(w)).withColumn("_r", F.row_number().over(w)).withColumn("_n", n).where("_r <= _n - 2").drop("_r", "_n")


def since_last(frames: DataFrame, onsets: DataFrame) -> DataFrame:
    """Frames (recording_id, frame_idx, ...) with the last onset (recording_id, onset_idx) at or before them.

    One sorted pass over both tables; frames before the first onset go.
    """
    o = Window.partitionBy("recording_id").orderBy("frame_idx", "_side").rowsBetween(Window.unboundedPreceding, 0)
    marks = onsets.select("recording_id", F.col("onset_idx").alias("frame_idx")).distinct().withColumn("_side", F.lit(0))
    both = frames.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    return both.withColumn("onset_idx", F.max(F.when(F.col("_side") == 0, F.col("frame_idx"))).over(o)).where("_side = 1 and onset_idx is not null").drop("_side")
