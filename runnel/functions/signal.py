"""Numpy kernels for frames of samples: filters, spectra, mel bands, cepstra, pitch and vibrato."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np


def frames_of(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """All whole frames of ``size`` samples every ``step`` samples."""
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step]


def triangle(length: int) -> np.ndarray:
    """Up from 0 to 1 in the first half, down from 1 to 0 in the rest."""
    up = length // 2
    return np.concatenate((np.linspace(0, 1, up), np.linspace(1, 0, length - up)))


def mel_filter_bank(n: int, bins: int, sample_rate: float, add_energy: bool = False) -> np.ndarray:
    """(n, bins) triangular filters, evenly spaced in mel up to half the rate; add_energy puts a flat one first."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.arange(n + 2) * to_mel(sample_rate / 2) / (n + 1) / 2595) - 1)
    at = np.round(edges / (sample_rate / 2) * (bins - 1)).astype(int)
    bank = np.zeros((n, bins))
    for k in range(n):
        lo, hi = at[k], max(at[k] + 1, at[k + 2])
        bank[k, lo : hi + 1] = triangle(hi + 1 - lo)[: bins - lo]
    return np.vstack((np.ones((1, bins)), bank)) if add_energy else bank


def spectrum(frames: np.ndarray, n_fft: int, power: bool = True) -> np.ndarray:
    """Magnitude or power of Hamming-windowed frames, zero-padded, without the last bin."""
    s = np.abs(np.fft.rfft(frames * np.hamming(frames.shape[1]), n_fft, axis=1))[:, : n_fft // 2]
    return s**2 if power else s


def band_pass(taps: int, low: float, high: float) -> np.ndarray:
    """Windowed-sinc band-pass of ``taps`` coefficients, cut-offs as shares of half the rate, with unit
    gain at the centre of the band."""
    m = np.arange(taps) - (taps - 1) / 2
    h = (high * np.sinc(high * m) - low * np.sinc(low * m)) * np.hamming(taps)
    centre = (low + high) / 2 if low > 0 else 0.0
    return h / np.sum(h * np.cos(np.pi * m * centre))


def band_weights(h: np.ndarray, bands: int) -> np.ndarray:
    """Weights that give the sum over bands of filtering along them: one dot product."""
    return np.cumsum(h)[np.arange(bands - 1, -1, -1)]


def fir(h: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered ``x`` and the last inputs, which go in again with the next block."""
    before = np.zeros(len(h) - 1) if state is None else state
    full = np.concatenate((before, x))
    return np.convolve(full, h, "valid"), full[len(full) - len(h) + 1 :]


def yin_difference(x: np.ndarray, lags: int) -> np.ndarray:
    """Sum of squared differences at lags 0 to lags - 1, over the first len(x) - lags samples."""
    n = len(x) - lags
    pairs = np.lib.stride_tricks.sliding_window_view(x, n)[:lags]
    return ((pairs - x[:n]) ** 2).sum(1)


def yin_normalized(d: np.ndarray) -> np.ndarray:
    """Each difference by the running mean of those before it; 1 where that is 0."""
    out, total = np.ones(len(d)), np.cumsum(d[1:])
    with np.errstate(divide="ignore", invalid="ignore"):
        out[1:] = np.where(total > 0, d[1:] * np.arange(1, len(d)) / total, 1.0)
    return out


def yin_pick(curve: np.ndarray, least: int, limit: float) -> int:
    """The first dip below the limit, followed down to its bottom; 0 if there is none."""
    below = np.flatnonzero(curve[least:] < limit)
    if not len(below):
        return 0
    k = least + int(below[0])
    while k + 1 < len(curve) and curve[k + 1] < curve[k]:
        k += 1
    return k


def pitch(frame: np.ndarray, rate: float, low: float, high: float, limit: float = 0.3) -> tuple[float, float]:
    """(confidence, pitch in Hz): the curve's minimum, at most 1, and rate by the picked lag, 0 if unvoiced."""
    lags = min(int(rate / low), len(frame) // 2)
    if lags < 4:
        return 1.0, 0.0
    curve = yin_normalized(yin_difference(np.asarray(frame, float), lags))
    k = yin_pick(curve, max(2, int(rate / high)), limit)
    return float(min(1.0, curve[2:-1].min())), rate / k if k else 0.0


def harmonicity(frame: np.ndarray, rate: float, low: float) -> float:
    """The confidence alone."""
    return pitch(frame, rate, low, rate / 2)[0]


def has_vibrato(x: np.ndarray, rate: float, low: float = 4.0, high: float = 8.0, n_fft: int = 100) -> bool:
    """Whether the strongest bin of the first difference's spectrum lies between two frequencies."""
    d = np.diff(x)[:-1]
    if len(d) < 2:
        return False
    s = np.abs(np.fft.fft(d, n_fft))[: n_fft // 2]
    f = int(s.argmax()) * rate / n_fft
    return bool(s.max() > 0 and low <= f <= high)


def deltas(x: np.ndarray, reach: int = 2) -> np.ndarray:
    """Regression slopes over frames, the end rows repeated."""
    n = len(x)
    p = np.pad(x, ((reach, reach), (0, 0)), mode="edge")
    return sum(k * (p[reach + k : reach + k + n] - p[reach - k : reach - k + n]) for k in range(1, reach + 1)) / (2 * sum(k * k for k in range(1, reach + 1)))


def cepstra(frames: np.ndarray, rate: float, n: int = 13, bands: int = 40, first: bool = True, low: float = 130.0, high: float = 6854.0) -> np.ndarray:
    """Mel-frequency cepstral coefficients; first: keep the 0th."""
    n_fft = 1 << int(np.ceil(np.log2(max(2, frames.shape[1]))))
    s = spectrum(frames, n_fft, power=False)
    f = np.arange(s.shape[1]) * rate / n_fft
    mel = np.linspace(1127 * np.log(1 + low / 700), 1127 * np.log(1 + min(high, rate / 2) / 700), bands + 2)
    e = 700 * (np.exp(mel / 1127) - 1)
    bank = np.maximum(0, np.minimum((f[None] - e[:-2, None]) / (e[1:-1] - e[:-2])[:, None], (e[2:, None] - f[None]) / (e[2:] - e[1:-1])[:, None]))
    logs = np.log(np.maximum(s @ bank.T, 1e-10))
    k = np.arange(0 if first else 1, n + (0 if first else 1))
    basis = np.sqrt(2 / bands) * np.cos(np.pi * k[:, None] * (np.arange(bands) + 0.5)[None] / bands)
    return logs @ basis.T


@dataclass(frozen=True)
class Step:
    name: str
    options: dict[str, str] = field(default_factory=dict)


def parse_plan(text: str) -> tuple[str, list[Step]]:
    """The output's name and the steps of ``name: FEATURE k=v ... > STEP k=v``."""
    name, _, rest = text.partition(":")
    steps = []
    for part in rest.split(">"):
        words = part.split()
        if not words or any("=" not in w for w in words[1:]):
            raise ValueError(f"not a feature plan: {text!r}")
        steps.append(Step(words[0], dict(w.split("=", 1) for w in words[1:])))
    if not re.fullmatch(r"\w+", name.strip()):
        raise ValueError(f"not a feature plan: {text!r}")
    return name.strip(), steps


def run_plan(text: str, x: np.ndarray, rate: float) -> np.ndarray:
    """The feature matrix that a plan describes, over one recording's samples."""
    _, steps = parse_plan(text)
    head, out = steps[0], None
    size, step = int(head.options.get("blockSize", 1024)), int(head.options.get("stepSize", 256))
    f = frames_of(np.asarray(x, float), size, step)
    if head.name == "MFCC":
        out = cepstra(f, rate, int(head.options.get("CepsNbCoeffs", 13)), int(head.options.get("MelNbFilters", 40)), head.options.get("CepsIgnoreFirstCoeff", "1") == "0", float(head.options.get("MelMinFreq", 130.0)), float(head.options.get("MelMaxFreq", 6854.0)))
    elif head.name == "ZCR":
        out = ((f[:, 1:] * f[:, :-1]) < 0).mean(1, keepdims=True)
    elif head.name == "Energy":
        out = np.sqrt((f**2).mean(1, keepdims=True))
    else:
        raise ValueError(f"unknown feature {head.name}")
    for s in steps[1:]:
        if s.name != "Derivate":
            raise ValueError(f"unknown step {s.name}")
        for _ in range(int(s.options.get("DOrder", 1))):
            out = deltas(out)
    return out
