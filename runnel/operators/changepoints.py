"""Divergence segmentation: a long-term against a short-term autoregressive model.

The long-term model follows the signal from the last cut by a Burg lattice with a decaying gain,
the short-term one is fitted by Levinson-Durbin to a sliding window. Their divergence is summed; a
drop of the sum below its maximum by more than ``limit`` makes a cut at the maximum. State starts
anew at each cut, so one recording is one task; recordings run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from runnel.functions.signal import band_pass, fir


class LongModel:
    """Lattice filter whose reflection coefficients average over all samples so far."""

    def __init__(self, order: int):
        self.order, self.n = order, 0
        self.back, self.cross, self.power = np.zeros(order + 1), np.zeros(order), np.full(order, 1e-12)
        self.variance = 0.0

    def update(self, x: float) -> float:
        self.n += 1
        forward, old = x, self.back.copy()
        self.back[0] = x
        for k in range(self.order):
            self.cross[k] += forward * old[k]
            self.power[k] += 0.5 * (forward * forward + old[k] * old[k])
            r = self.cross[k] / self.power[k]
            forward, self.back[k + 1] = forward - r * old[k], old[k] - r * forward
        self.variance += (forward * forward - self.variance) / self.n
        return forward


def levinson(r: np.ndarray) -> tuple[np.ndarray, float]:
    """Prediction coefficients (the first is 1) and the error of an autocorrelation."""
    a, e = np.zeros(len(r)), float(r[0])
    a[0] = 1.0
    for k in range(1, len(r)):
        if e <= 0:
            break
        g = -float(a[:k] @ r[k:0:-1]) / e
        a[1 : k + 1] = a[1 : k + 1] + g * a[k - 1 :: -1][:k]
        e *= 1 - g * g
    return a, e


class ShortModel:
    """Autoregressive model of the last ``width`` samples; its autocorrelation slides in O(order)."""

    def __init__(self, order: int, width: int, x: np.ndarray, end: int):
        self.order, self.width, self.x = order, width, x
        w = x[end - width : end]
        self.r = np.array([w[k:] @ w[: width - k] for k in range(order + 1)])

    def update(self, end: int) -> tuple[float, float]:
        """Takes in sample end - 1; its residual and the model's residual variance."""
        x, lo = self.x, end - 1 - self.width
        for k in range(self.order + 1):
            self.r[k] += x[end - 1] * x[end - 1 - k] - x[lo] * x[lo + k]
        a, e = levinson(self.r)
        return float(a @ x[end - 1 - np.arange(self.order + 1)]), max(e / self.width, 0.0)


def divergence(es: float, el: float, vs: float, vl: float) -> float:
    q = vs / vl
    return (2 * es * el / vl - (1 + q) * el * el / vl + q - 1) / (2 * q)


def next_cut(x: np.ndarray, start: int, order: int, width: int, limit: float, bias: float) -> tuple[int, bool] | None:
    """The next cut after ``start`` and whether the models held; None at the end of the signal."""
    long, first = LongModel(order), start + width
    if first >= len(x):
        return None
    for k in range(start, first):
        long.update(x[k])
    short = ShortModel(order, width, x, first)
    total, top, at = 0.0, 0.0, first
    for end in range(first + 1, len(x) + 1):
        el = long.update(x[end - 1])
        es, vs = short.update(end)
        if vs <= 1e-12 or long.variance <= 1e-12:
            if vs <= 1e-12 and long.variance <= 1e-12:
                continue  # silence on both sides
            return end - 1, False
        total += divergence(es, el, vs, long.variance) - bias
        if total > top:
            top, at = total, end
        elif top - total > limit:
            return max(at, start + width), True
    return None


def segment(x: np.ndarray, rate: float, order: int = 2, least: float = 0.02, limit: float = 40.0, bias: float = -0.2, backward: bool = True) -> list[tuple[int, int]]:
    """(sample, label) cuts: 1 forward, -1 set by the pass backward, 0 where a model broke down.

    After each forward cut the piece is run through from its end; the last cut found that way
    takes the place of the forward one.
    """
    width, cuts, start = max(order + 2, int(least * rate)), [], 0
    while (found := next_cut(x, start, order, width, limit, bias)) is not None:
        cut, stable = found
        label = 1 if stable else 0
        if not stable:
            cut = start + width
        elif backward and cut - start > 2 * width:
            piece, at, last = x[start:cut][::-1], 0, None
            while (b := next_cut(piece, at, order, width, limit, bias)) is not None and b[0] > at:
                last = at = b[0]
            if last is not None and cut - last > start + width:
                cut, label = cut - last, -1
        cuts.append((cut, label))
        start = cut
    return cuts


def hybrid_segment(x: np.ndarray, rate: float, order: int = 2, least: float = 0.01) -> list[tuple[int, int]]:
    """(sample, label) cuts of the raw signal (label 1), moved to a cut of the band-passed one (label 2)
    where that has one at least two windows after the last cut and not after the raw one. The last
    cut is the end of the signal."""
    if not len(x):
        return []
    width = max(6, int(least * rate))
    low = fir(band_pass(129, 0.02, 0.5), x)[0]
    filtered = [c for c, s in segment(low, rate, 4, max(0.0025, 8 / rate), 80.0, -0.8, backward=False)]
    cuts, start = [], 0
    while (found := next_cut(x, start, order, width, 40.0, -0.2)) is not None:
        cut, stable = found
        cut = max(cut if stable else start + width, start + width)
        inside = [c for c in filtered if start + 2 * width + 1 <= c <= cut]
        label = 1
        if inside:
            cut, label = inside[0], 2
        elif cut - start > 5 * width:
            back = next_cut(x[start:cut][::-1], 0, order, max(width, int(0.02 * rate)), 40.0, -0.2)
            if back is not None and cut - back[0] > start + width:
                cut = cut - back[0]
        cuts.append((cut, label))
        start = cut
    return [*(c for c in cuts if c[0] < len(x)), (len(x), 1)]


def drops(increments: np.ndarray, limit: float) -> list[int]:
    """Cuts where the running sum falls under its maximum by more than ``limit``; each at the maximum, where the sum restarts."""
    cuts, start, k = [], 0, 0
    while k < len(increments):
        s = np.cumsum(increments[start:])
        m = np.maximum.accumulate(np.maximum(s, 0.0))
        fall = np.flatnonzero(m - s > limit)
        if not len(fall):
            break
        end = int(fall[0])
        k = start = start + max(1, (int(s[: end + 1].argmax()) if s[: end + 1].max() > 0 else end) + 1)
        cuts.append(start)
    return cuts


def cut_recordings(samples: DataFrame, rate: float, method: str = "segment", **options) -> DataFrame:
    """recording_id, t, label events; samples: recording_id, frame_idx, value (one row per sample or per block).

    A block's values are an array and come in the order of frame_idx. One recording is one task.
    """
    run = {"segment": segment, "hybrid": hybrid_segment}[method]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        v = pdf.value.to_numpy()
        x = np.concatenate([np.asarray(b, float) for b in v]) if len(v) and np.ndim(v[0]) else v.astype(float)
        found = run(x, rate, **options)
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "t": [c / rate for c, _ in found], "label": [lab for _, lab in found]})

    kind = dict(samples.dtypes)["recording_id"]
    return samples.select("recording_id", "frame_idx", "value").groupBy("recording_id").applyInPandas(cut, f"recording_id {kind}, t double, label int")
