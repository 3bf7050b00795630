"""Column expressions for scores, frames and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def confidence(v, limit: float) -> Column:
    """(v - limit) / limit, at most 1."""
    return F.least((_c(v) - limit) / limit, F.lit(1.0))


def many_segments_confidence(v, limit: float = 20) -> Column:
    """High for few segments: -(v - limit) / limit below twice the limit, else -1."""
    return F.when(_c(v) < 2 * limit, -(_c(v) - limit) / limit).otherwise(-1.0)


def long_segments_confidence(v, limit: float = 0.05) -> Column:
    return F.when(_c(v) < 2 * limit, (_c(v) - limit) / limit).otherwise(1.0)


def clip(v, low: float | None, high: float | None) -> Column:
    """Bounded on both sides; unchanged if either bound is missing."""
    return _c(v) if low is None or high is None else F.greatest(F.lit(low), F.least(F.lit(high), _c(v)))


def int16(x) -> Column:
    """Samples in [-1, 1] as 16-bit integers, cut toward zero."""
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), _c(x) * 32768)).cast("smallint")


def ln0(x) -> Column:
    """Natural logarithm with -inf at 0."""
    return F.when(_c(x) == 0, F.lit(float("-inf"))).otherwise(F.ln(_c(x)))


def rms(frame) -> Column:
    f = _c(frame)
    return F.sqrt(F.aggregate(f, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(f), F.lit(0)))


def zero_crossings(frame) -> Column:
    """Sign changes between neighbours, by the number of samples."""
    f = _c(frame)
    n = F.size(f)
    pairs = F.zip_with(F.slice(f, 1, F.greatest(n - 1, F.lit(0))), F.slice(f, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a * b < 0, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / F.nullif(n, F.lit(0))


def dot(frame, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(_c(frame), w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def hamming(n: int) -> list[float]:
    """The symmetric Hamming window."""
    return [0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)) if n > 1 else 1.0 for k in range(n)]


def windowed(frame, n: int) -> Column:
    w = F.array(*[F.lit(x) for x in hamming(n)])
    return F.zip_with(_c(frame), w, lambda a, b: a * b)


def cents(f, reference: float = 13.75) -> Column:
    return 1200 * F.log2(_c(f) / reference)


def node_distance(f1, a1, f2, a2, cf: float = 100.0, cp: float = 3.0) -> Column:
    """Distance of two sinusoidal nodes from their pitch in cents and log amplitude."""
    return F.sqrt(F.pow((cents(f1) - cents(f2)) / cf, 2) + F.pow((F.log10(_c(a1)) - F.log10(_c(a2))) / cp, 2))


def half_tone_ratio(a, b) -> Column:
    """Larger by smaller, 0 if one is not positive."""
    low = F.least(_c(a), _c(b))
    return F.when(low > 0, F.greatest(_c(a), _c(b)) / F.nullif(low, F.lit(0.0))).otherwise(0.0)


def divergence(e_short, e_long, var_short, var_long) -> Column:
    """The two-model divergence statistic from residuals and residual variances."""
    q = _c(var_short) / F.nullif(_c(var_long), F.lit(0.0))
    el, es, vl = _c(e_long), _c(e_short), F.nullif(_c(var_long), F.lit(0.0))
    return (2 * es * el / vl - (1 + q) * el * el / vl + q - 1) / (2 * q)


def pattern_distance(series, pattern: list[float], eps: float = 1.1920929e-07) -> Column:
    """struct<distance, shift>: the least mean absolute difference of a pattern and the normalized
    series at any shift, the series being padded with zeros on the right."""
    n = len(pattern)
    padded = F.concat(_c(series), F.array_repeat(F.lit(0.0), n - 1))
    p = F.array(*[F.lit(float(x)) for x in pattern])

    def at(k: Column) -> Column:
        # the slice is bound once: a lambda would evaluate it for each element
        piece = F.array(F.slice(padded, k + 1, n))
        return F.transform(piece, lambda s: F.transform(F.array(F.greatest(F.array_max(s), F.lit(eps))), lambda m: F.aggregate(F.zip_with(s, p, lambda a, b: F.abs(a / m - b)), F.lit(0.0), lambda a, x: a + x) / n)[0])[0]

    shifts = F.transform(F.sequence(F.lit(0), F.size(_c(series)) - 1), lambda k: F.struct(at(k).alias("distance"), k.alias("shift")))
    return F.array_min(shifts)


#: Parameters (theta1, theta2, beta1, beta2, delta) of the two pitch-confidence models.
WEIBULL_MONO = (0.1007, 0.0029, 0.5955, 0.2821, 0.848)
WEIBULL_POLY = (0.3224, 0.0121, 1.889, 0.8705, 0.644)


def weibull(m, v, parameters: tuple[float, ...]) -> Column:
    """Log density of a bivariate Weibull law at (m, v), both positive."""
    t1, t2, b1, b2, d = parameters
    a, b = _c(m) / t1, _c(v) / t2
    s0 = F.pow(a, F.lit(b1 / d)) + F.pow(b, F.lit(b2 / d))
    s = F.pow(s0, F.lit(d))
    return F.lit(math.log(b1 * b2 / (t1 * t2))) + (b1 / d - 1) * F.ln(a) + (b2 / d - 1) * F.ln(b) + (d - 2) * F.ln(s0) + F.ln(s + 1 / d - 1) - s
