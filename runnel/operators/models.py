"""Gaussian mixtures, adaptation, monophony decisions and Viterbi decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runnel.functions.columns import WEIBULL_MONO, WEIBULL_POLY, weibull
from runnel.operators.windows import by_frame


def log_sum_exp(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Logarithm of the sum of exponentials of each group, shifted by its maximum."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_m"))
    return df.join(top, keys).groupBy(*keys, "_m").agg((F.col("_m") + F.ln(F.sum(F.exp(F.col(value) - F.col("_m"))))).alias(out)).drop("_m")


def gaussians(long: DataFrame, by: str) -> DataFrame:
    """Mean and population variance of each dimension for each value of ``by``."""
    return long.groupBy(by, "dim").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"), F.count("x").alias("n"))


def mixture(gaussian: DataFrame, model_id: str, component: str) -> DataFrame:
    """model_id, k, weight, mu[], var[] from (model, component, dim, mu, var, n) rows."""
    size = Window.partitionBy(model_id)
    rows = gaussian.groupBy(model_id, component).agg(F.array_sort(F.collect_list(F.struct("dim", "mu", "var"))).alias("d"), F.max("n").alias("n"))
    return rows.select(F.col(model_id).alias("model_id"), F.col(component).alias("k"), (F.col("n") / F.sum("n").over(size)).alias("weight"), F.col("d.mu").alias("mu"), F.col("d.var").alias("var"))


#: A model table with so many components at most is sent to every task.
MODEL_ROWS = 100_000


def log_likelihood(features: DataFrame, gmm: DataFrame, use_weights: bool = False) -> DataFrame:
    """recording_id, frame_idx, model_id, llh of each frame under each mixture of diagonal Gaussians.

    Component weights count only with ``use_weights``. All in one pass over the features: the
    model table is broadcast once it is known to be small, and each frame meets one row per model.
    """
    if gmm.limit(MODEL_ROWS + 1).count() > MODEL_ROWS:
        raise ValueError(f"a model table may have {MODEL_ROWS} components")
    parts = gmm.withColumn("c", F.aggregate("var", F.lit(0.0), lambda a, v: a + F.ln(2 * math.pi * v)) - (2 * F.ln("weight") if use_weights else F.lit(0.0)))
    models = parts.groupBy("model_id").agg(F.collect_list(F.struct("mu", "var", "c")).alias("parts"))
    met = features.select("recording_id", "frame_idx", "f").crossJoin(F.broadcast(models))

    def one(p):
        d = F.zip_with(F.zip_with("f", p["mu"], lambda x, m: (x - m) * (x - m)), p["var"], lambda s, v: s / v)
        return -0.5 * (F.aggregate(d, F.lit(0.0), lambda a, x: a + x) + p["c"])

    lls = F.transform("parts", one)
    shifted = F.transform(F.array(lls), lambda v: F.transform(F.array(F.array_max(v)), lambda m: m + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m))))[0])[0]
    return met.select("recording_id", "frame_idx", "model_id", shifted.alias("llh"))


def log_ratio(llh: DataFrame, yes, no) -> DataFrame:
    """recording_id, frame_idx, llr = 0.5 + 0.5 (llh of ``yes`` - llh of ``no``)."""
    a = F.max(F.when(F.col("model_id") == yes, F.col("llh")))
    b = F.max(F.when(F.col("model_id") == no, F.col("llh")))
    return llh.groupBy("recording_id", "frame_idx").agg((0.5 + 0.5 * (a - b)).alias("llr"))


def gaussian_ratio(long: DataFrame, trained: DataFrame, keys: list[str]) -> DataFrame:
    """llr of single Gaussians: long (keys, dim, x) against trained (recording_id, side, dim, mu, var)."""
    met = long.join(trained, ["recording_id", "dim"])
    ll = -0.5 * (F.ln(2 * math.pi * F.col("var")) + F.pow(F.col("x") - F.col("mu"), 2) / F.col("var"))
    signed = F.when(F.col("side") == 1, ll).otherwise(-ll)
    return met.where("var > 0").groupBy(*keys).agg((0.5 + 0.5 * F.sum(signed)).alias("llr"))


def monophony(frames: DataFrame, value: str, block: int = 50, hop: int = 25, width: int = 10, eps: float = 1e-15) -> DataFrame:
    """recording_id, block_idx, mono, poly, label for blocks of ``block`` frames every ``hop`` frames.

    Inside a block the mean and variance of every window of ``width`` frames are scored by the
    two Weibull models; the better mean decides (1 mono, 0 poly).
    """
    w = by_frame().rowsBetween(0, width - 1)
    r = frames.select("recording_id", "frame_idx", F.avg(value).over(w).alias("m"), (F.var_pop(value).over(w) + eps).alias("v"), F.count(value).over(w).alias("n")).where((F.col("n") == width) & (F.col("m") > 0))
    n = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("frames"))
    first = F.greatest(F.lit(0), F.ceil((F.col("frame_idx") - (block - width - 1)) / hop))
    blocks = r.join(n, "recording_id").withColumn("block_idx", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("frame_idx") / hop)))))
    inside = (F.col("frame_idx") >= F.col("block_idx") * hop) & (F.col("frame_idx") < F.col("block_idx") * hop + block - width) & (F.col("block_idx") * hop + block <= F.col("frames"))
    scored = blocks.where(inside).groupBy("recording_id", "block_idx").agg(F.avg(weibull("m", "v", WEIBULL_MONO)).alias("mono"), F.avg(weibull("m", "v", WEIBULL_POLY)).alias("poly"))
    return scored.withColumn("label", (F.col("mono") > F.col("poly")).cast("int"))


def viterbi_path(scores: np.ndarray, penalty: float, transition: np.ndarray | None = None, initial: np.ndarray | None = None, final: np.ndarray | None = None, duration: int = 1) -> tuple[list[tuple[int, int, int]], float]:
    """(start, count, unit) segments of the best path and its mean score per frame.

    scores: frames x units, log domain. Changing the unit costs ``penalty`` plus the transition's
    log probability, and a unit holds at least ``duration`` frames (a chain of states). On ties
    the first unit wins and a path stays where it is.
    """
    n, units = scores.shape
    if not n:
        return [], 0.0
    enter = (np.zeros((units, units)) if transition is None else np.asarray(transition, float)) - penalty
    enter = enter.copy()
    np.fill_diagonal(enter, -np.inf)
    best = np.full((units, duration), -np.inf)
    best[:, 0] = scores[0] + (0 if initial is None else initial)
    back = np.zeros((n, units, duration), np.int64)  # 0: same or previous state, u + 1: from the end of u
    for t in range(1, n):
        ends = best[:, -1]
        came = ends[:, None] + enter
        source = came.argmax(0)
        new = np.full_like(best, -np.inf)
        change = came[source, np.arange(units)]
        if duration > 1:
            new[:, 0], back[t, :, 0] = change, source + 1
            new[:, 1:-1] = best[:, :-2]
            new[:, -1] = np.maximum(best[:, -1], best[:, -2])
            back[t, :, -1] = np.where(best[:, -1] >= best[:, -2], 0, -1)
            back[t, :, 1:-1] = -1
        else:
            stay = best[:, 0]
            move = change > stay
            new[:, 0] = np.where(move, change, stay)
            back[t, :, 0] = np.where(move, source + 1, 0)
        best = new + scores[t][:, None]
    total = best[:, -1] + (0 if final is None else final)
    unit, state = int(total.argmax()), duration - 1
    score, path = float(total[unit]), np.zeros(n, np.int64)
    if not np.isfinite(score):  # no unit can hold its duration: the best single one
        unit = int(scores.sum(0).argmax())
        return [(0, n, unit)], float(scores[:, unit].mean())
    for t in range(n - 1, -1, -1):
        path[t] = unit
        b = back[t, unit, state] if t else 0
        if b > 0:
            unit, state = b - 1, duration - 1
        elif b < 0:
            state -= 1
    cuts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
    return [(int(a), int(b - a), int(path[a])) for a, b in zip(cuts, cuts[1:])], score / n


def viterbi(llh: DataFrame, models: list, penalty: float = 50.0, duration: int = 1) -> DataFrame:
    """recording_id, start_idx, n, model_id, score: the best path of each recording.

    The recursion runs over one recording after another, each in one task: it has no parallel form.
    """

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="frame_idx", columns="model_id", values="llh").reindex(columns=models).sort_index()
        segments, score = viterbi_path(m.to_numpy(), penalty, duration=duration)
        at = m.index.to_numpy()
        return pd.DataFrame([(pdf.recording_id.iloc[0], at[a], n, models[u], score) for a, n, u in segments], columns=["recording_id", "start_idx", "n", "model_id", "score"])

    kind = dict(llh.dtypes)
    return llh.groupBy("recording_id").applyInPandas(decode, f"recording_id {kind['recording_id']}, start_idx long, n long, model_id {kind['model_id']}, score double")


def matrix_log_likelihood(features: DataFrame, models: list[tuple], use_weights: bool = False) -> DataFrame:
    """As ``log_likelihood``, by matrix products in Arrow batches, for many large mixtures.

    models: (model_id, weights, means, variances) numpy arrays held by the driver.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf.f.to_numpy()) if len(pdf) else np.zeros((0, 1))
            for model_id, w, mu, var in models:
                if not len(x):
                    continue
                c = (mu**2 / var).sum(1) + np.log(2 * np.pi * var).sum(1) - (2 * np.log(w) if use_weights else 0)
                ll = -0.5 * (c[None, :] + x**2 @ (1 / var).T - 2 * x @ (mu / var).T)
                top = ll.max(1)
                yield pd.DataFrame({"recording_id": pdf.recording_id, "frame_idx": pdf.frame_idx, "model_id": model_id, "llh": top + np.log(np.exp(ll - top[:, None]).sum(1))})

    kind = "string" if models and isinstance(models[0][0], str) else "long"
    return features.select("recording_id", "frame_idx", "f").mapInPandas(score, f"recording_id {dict(features.dtypes)['recording_id']}, frame_idx long, model_id {kind}, llh double")
