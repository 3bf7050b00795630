"""Sliding-window operators over framewise series.

All take a DataFrame with ``recording_id``, ``frame_idx`` and a value column, use one window
specification per call and so sort a recording once. A recording's rows meet in one task only for
the window itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: The least positive 32-bit step, which stands in for values that have no logarithm.
EPS = 1.1920929e-07

def by_frame() -> WindowSpec:
    """A recording's frames in order. A function, as a window needs a session and workers have none."""
    return Window.partitionBy("recording_id").orderBy("frame_idx")


def whole() -> WindowSpec:
    return by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def frame_count() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("recording_id"))


def modulation(df: DataFrame, w_len: int, log: bool = True, value: str = "value", digits: int | None = None) -> DataFrame:
    """Adds ``modulation``: the population variance of (the logarithm of) the value around a frame.

    Rows [-w, w - 1] with w = w_len // 2. The first w frames take the first computed value, the
    last w the last; series of fewer than 2 w frames are null.
    """
    w = w_len // 2
    x = F.ln(F.when(F.col(value) <= 0, F.lit(EPS)).otherwise(F.col(value))) if log else F.col(value)
    v = F.var_pop(x).over(by_frame().rowsBetween(-w, w - 1))
    row, n = F.row_number().over(by_frame()) - 1, F.count(F.lit(1)).over(whole())
    v = F.when((row >= w) & (row < n - w), F.round(v, digits) if digits is not None else v)
    out = df.withColumn("_v", v)
    edge = F.when(F.row_number().over(by_frame()) - 1 < w, F.first("_v", ignorenulls=True).over(whole())).otherwise(F.last("_v", ignorenulls=True).over(whole()))
    return out.withColumn("modulation", F.coalesce("_v", edge)).drop("_v")


def majority(df: DataFrame, flag: str, width: int, out: str = "median") -> DataFrame:
    """Median filter of odd width on booleans, zero-padded: the majority of the window."""
    half = width // 2
    return df.withColumn(out, F.sum(F.col(flag).cast("int")).over(by_frame().rowsBetween(-half, half)) >= half + 1)


def slide(df: DataFrame, value: str, width: int, function: Callable[[Column], Column], out: str) -> DataFrame:
    """``function`` of rows [-(width // 2), width - 1 - width // 2]; ends count what there is, which for
    minimum and maximum equals repeating the end values."""
    left = width // 2
    return df.withColumn(out, function(F.col(value)).over(by_frame().rowsBetween(-left, width - 1 - left)))


def dilate(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    return slide(df, value, width, F.max, out)


def erode(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    return slide(df, value, width, F.min, out)


def smooth(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    """Sliding mean with the end values repeated beyond both ends."""
    left, right = width // 2, width - 1 - width // 2
    row = F.row_number().over(by_frame()) - 1
    n = F.count(F.lit(1)).over(whole())
    first, last = F.first(value).over(whole()), F.last(value).over(whole())
    total = F.sum(value).over(by_frame().rowsBetween(-left, right))
    total = total + F.greatest(F.lit(0), left - row) * first + F.greatest(F.lit(0), row + right - (n - 1)) * last
    return df.withColumn(out, total / width)


def dilate_erode(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    """Dilation, two erosions, dilation: no run above or below a level stays shorter than the width."""
    step = dilate(df, value, width, "_a")
    step = erode(step, "_a", width, "_b")
    step = erode(step, "_b", width, "_c")
    return dilate(step, "_c", width, out).drop("_a", "_b", "_c")


def binary_erosion(df: DataFrame, flag: str, length: int, out: str) -> DataFrame:
    """A frame stays set if its whole neighbourhood is; beyond the ends nothing is set."""
    left = length // 2
    w = by_frame().rowsBetween(-left, length - 1 - left)
    return df.withColumn(out, (F.sum(F.col(flag).cast("int")).over(w) == length))


def binary_dilation(df: DataFrame, flag: str, length: int, out: str) -> DataFrame:
    """The mirrored neighbourhood of a set frame is set."""
    left = length - 1 - length // 2
    return df.withColumn(out, F.max(F.col(flag).cast("int")).over(by_frame().rowsBetween(-left, length // 2)) == 1)


def opening(df: DataFrame, flag: str, length: int, out: str) -> DataFrame:
    """Erosion, then dilation: runs shorter than ``length`` go."""
    return binary_dilation(binary_erosion(df, flag, length, "_e"), "_e", length, out).drop("_e")


def closing(df: DataFrame, flag: str, length: int, out: str) -> DataFrame:
    """Dilation, then erosion: gaps shorter than ``length`` close; the ends are eaten."""
    return binary_erosion(binary_dilation(df, flag, length, "_d"), "_d", length, out).drop("_d")


def two_sided_divergence(long: DataFrame, width: int) -> DataFrame:
    """recording_id, frame_idx, divergence: sum over dimensions of (m1 - m2)^2 / (s1 s2) of the
    ``width`` frames before a frame and from it on, where both are complete. long: dim, x rows.
    Dimensions with no spread on one side add nothing."""
    o = Window.partitionBy("recording_id", "dim").orderBy("frame_idx")
    left, right = o.rowsBetween(-width, -1), o.rowsBetween(0, width - 1)
    d = long.select(
        "recording_id", "frame_idx", F.avg("x").over(left).alias("m1"), F.stddev_pop("x").over(left).alias("s1"), F.count("x").over(left).alias("n1"),
        F.avg("x").over(right).alias("m2"), F.stddev_pop("x").over(right).alias("s2"), F.count("x").over(right).alias("n2"),
    ).where((F.col("n1") == width) & (F.col("n2") == width))
    part = F.pow(F.col("m1") - F.col("m2"), 2) / F.nullif(F.col("s1") * F.col("s2"), F.lit(0.0))
    return d.groupBy("recording_id", "frame_idx").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("divergence"))


def median_of(df: DataFrame, value: str, points: int, out: str) -> DataFrame:
    """Median of rows [-w, w - 1], w = points // 2 (so an odd count loses one point); 0 at the ends."""
    w = points // 2
    row, n = F.row_number().over(by_frame()) - 1, F.count(F.lit(1)).over(whole())
    x = F.percentile(value, 0.5).over(by_frame().rowsBetween(-w, w - 1))
    return df.withColumn(out, F.when((row >= w) & (row < n - w), x).otherwise(0.0))


def rank_slices(df: DataFrame, value: str, exclude: float, keep: float) -> DataFrame:
    """Adds ``side``: 0 for the low confident ranks, 1 for the high ones; other rows go.

    Of n rows by rising value those ranked [int(exclude n), int(keep n)) are low and
    [int((1 - keep) n), int((1 - exclude) n)) high; ties go by frame.
    """
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy(value, "frame_idx")) - 1
    n = frame_count()
    at = lambda share: F.floor(n * F.lit(share) + 1e-9)
    side = F.when((rank >= at(exclude)) & (rank < at(keep)), 0).when((rank >= at(1 - keep)) & (rank < at(1 - exclude)), 1)
    return df.withColumn("side", side).where("side is not null")


def derivative(df: DataFrame, value: str, reach: int, out: str) -> DataFrame:
    """Regression slope over ``reach`` frames on both sides, the end values repeated."""
    first, last = F.first(value).over(whole()), F.last(value).over(whole())
    total = F.lit(0.0)
    for k in range(1, reach + 1):
        total = total + k * (F.coalesce(F.lead(value, k).over(by_frame()), last) - F.coalesce(F.lag(value, k).over(by_frame()), first))
    return df.withColumn(out, total / (2 * sum(k * k for k in range(1, reach + 1))))
