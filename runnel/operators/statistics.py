"""Entropy, determinants, Bayesian information criterion and votes, from sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_entropy(df: DataFrame, value: str, bins: int = 10, observed_bias: bool = False) -> DataFrame:
    """recording_id, entropy of each recording's values in equal bins from their least to their largest.

    Adds the logarithm of the bin width and takes off the bias (1 - bins) / (2 n); observed_bias
    takes its floor, as integer division gives. A recording of one repeated value has a width as
    of a range of 1.
    """
    w = Window.partitionBy("recording_id")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    r = df.select("recording_id", F.col(value).alias("_v"), F.when(hi > lo, lo).otherwise(lo - 0.5).alias("_lo"), (F.when(hi > lo, hi - lo).otherwise(1.0) / bins).alias("_s"))
    b = r.withColumn("_b", F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_s")), F.lit(bins - 1)))
    counts = b.groupBy("recording_id", "_b", "_s").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    bias = F.floor((1 - bins) / (2 * n)) if observed_bias else (1 - bins) / (2 * n)
    return counts.groupBy("recording_id").agg((-F.sum(F.col("c") * F.ln("c")) / n + F.ln(n) + F.ln(F.max("_s")) - bias).alias("entropy"))


def log_determinant(long: DataFrame, keys: list[str]) -> DataFrame:
    """Logarithm of the product of the dimensions' population variances."""
    return long.groupBy(*keys, "dim").agg(F.var_pop("x").alias("v")).groupBy(*keys).agg(F.sum(F.ln(F.nullif("v", F.lit(0.0)))).alias("logdet"))


def prefix_sums(long: DataFrame) -> DataFrame:
    """Adds n, s, q: running count, sum and sum of squares of each dimension, of centred values.

    Centring first keeps the variance of any range, taken by subtraction, exact for large offsets.
    """
    whole = Window.partitionBy("recording_id", "dim")
    o = whole.orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    c = long.withColumn("x", F.col("x") - F.avg("x").over(whole))
    return c.select("recording_id", "dim", "frame_idx", F.count("x").over(o).alias("n"), F.sum("x").over(o).alias("s"), F.sum(F.col("x") * F.col("x")).over(o).alias("q"))


def complexity(dims: int, n) -> Column:
    """The criterion's penalty for ``dims`` dimensions and n observations."""
    return F.lit(0.5 * (dims + 0.5 * dims * (dims + 1))) * F.ln(n)


def delta_bic(long: DataFrame, dims: int, penalty: float) -> DataFrame:
    """recording_id, frame_idx, r, bic: the gain of cutting a recording after its first r frames.

    N/2 log D0 - r/2 log D1 - (N - r)/2 log D2 - penalty P, the right part starting one frame
    after the cut. Cuts closer than dims + 2 to an end are left out, as are parts without spread.
    """
    p = prefix_sums(long)
    w = Window.partitionBy("recording_id", "dim")
    o = w.orderBy("frame_idx")
    ns, ss, qs = (F.last(c).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("n", "s", "q"))
    r = p.select("recording_id", "dim", "frame_idx", "n", "s", "q", ns.alias("n0"), ss.alias("s0"), qs.alias("q0"), F.lead("n").over(o).alias("n2"), F.lead("s").over(o).alias("s2"), F.lead("q").over(o).alias("q2"))
    var = lambda n, s, q: q / n - (s / n) * (s / n)
    c = F.col
    r = r.where((c("n") >= dims + 2) & (c("n") < c("n0") - dims - 2))
    v0, v1 = var(c("n0"), c("s0"), c("q0")), var(c("n"), c("s"), c("q"))
    v2 = var(c("n0") - c("n2"), c("s0") - c("s2"), c("q0") - c("q2"))
    low = F.least(v0, v1, v2)
    sums = r.groupBy("recording_id", "frame_idx", c("n").alias("r"), "n0").agg(F.sum(F.ln(F.when(v0 > 0, v0))).alias("d0"), F.sum(F.ln(F.when(v1 > 0, v1))).alias("d1"), F.sum(F.ln(F.when(v2 > 0, v2))).alias("d2"), F.min(low).alias("low"))
    bic = c("n0") / 2 * c("d0") - c("r") / 2 * c("d1") - (c("n0") - c("r")) / 2 * c("d2") - penalty * complexity(dims, c("n0"))
    return sums.where("low > 1e-12").select("recording_id", "frame_idx", "r", bic.alias("bic"))


def group_sums(long: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics (n, s, q) of each group and dimension."""
    return long.groupBy(*keys, "dim").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def pair_bic(sums: DataFrame, group: str, dims: int, penalty: float) -> DataFrame:
    """a, b, bic for each pair of groups (a < b) of a recording; at most 0 speaks for one group.

    Pairs of groups, not of frames: there are few.
    """
    c = F.col
    a = sums.select("recording_id", "dim", c(group).alias("a"), c("n").alias("n1"), c("s").alias("s1"), c("q").alias("q1"))
    b = sums.select("recording_id", "dim", c(group).alias("b"), c("n").alias("n2"), c("s").alias("s2"), c("q").alias("q2"))
    met = a.join(b, ["recording_id", "dim"]).where("a < b")
    var = lambda n, s, q: q / n - (s / n) * (s / n)
    v0 = var(c("n1") + c("n2"), c("s1") + c("s2"), c("q1") + c("q2"))
    part = (c("n1") + c("n2")) / 2 * F.ln(v0) - c("n1") / 2 * F.ln(var(c("n1"), c("s1"), c("q1"))) - c("n2") / 2 * F.ln(var(c("n2"), c("s2"), c("q2")))
    return met.groupBy("recording_id", "a", "b").agg((F.sum(part) - penalty * complexity(dims, F.max(c("n1") + c("n2")))).alias("bic"))


def percentile_penalty(penalties: list[float], th: float = 90.0) -> float:
    """The penalty at which the criterion has its th percentile: it falls with the penalty."""
    x = sorted(penalties)
    at = (len(x) - 1) * (100 - th) / 100
    k = math.floor(at)
    return x[k] + (at - k) * (x[min(k + 1, len(x) - 1)] - x[k])


def vote_density(cuts: DataFrame, voters: int) -> DataFrame:
    """recording_id, frame_idx, density: the share of voters that cut at a frame."""
    return cuts.groupBy("recording_id", "frame_idx").agg((F.count(F.lit(1)) / voters).alias("density"))
