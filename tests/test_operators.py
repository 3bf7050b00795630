import numpy as np
import pandas as pd
import pytest

from runnel.functions import signal as G
from runnel.operators import bic, changepoints, harmonic
from runnel.operators import segments as S
from runnel.operators import topk as K
from runnel.operators import windows as W
from runnel.operators.models import viterbi_path
from runnel.operators.statistics import percentile_penalty


def framewise(spark, values, name="value"):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], f"recording_id long, frame_idx long, {name} double")


def column(df, name):
    return [r[0] for r in df.orderBy("frame_idx").select(name).collect()]


def test_modulation_is_numpy_variance(spark):
    x = np.abs(np.random.default_rng(1).normal(size=40))
    got = column(W.modulation(framewise(spark, x.tolist()), 8), "modulation")
    inner = [np.log(x[k - 4 : k + 4]).var() for k in range(4, 36)]
    want = [inner[0]] * 4 + inner + [inner[-1]] * 4
    assert np.allclose(got, want)


@pytest.mark.parametrize("values", [[], [1.0], [0.0, 0.0, 0.0], [2.0] * 30])
def test_modulation_edges(spark, values):
    got = column(W.modulation(framewise(spark, values), 8), "modulation")
    assert got == ([0.0] * 30 if len(values) == 30 else [None] * len(values))


def test_dilate_erode_leaves_no_short_run(spark):
    x = np.random.default_rng(2).normal(size=300)
    on = np.array(column(W.dilate_erode(framewise(spark, x.tolist()), "value", 12, "o"), "o")) > 0.5
    cuts = np.flatnonzero(np.diff(on.astype(int)))
    assert len(cuts) < 2 or np.diff(cuts).min() >= 11


@pytest.mark.parametrize("pattern", ["0011100", "1", "0101010", "1111", "0000", "110111100111"])
@pytest.mark.parametrize("length", [2, 3, 4])
def test_opening_drops_short_runs(spark, pattern, length):
    df = spark.createDataFrame([(1, k, c == "1") for k, c in enumerate(pattern)], "recording_id long, frame_idx long, flag boolean")
    opened = [bool(v) for v in column(W.opening(df, "flag", length, "o"), "o")]
    plain = column(S.without_short_runs(df, "flag", length, "o"), "o")
    assert opened == plain


def test_runs_cover_and_alternate(spark):
    df = spark.createDataFrame([(r, k, "ab"[(k // 3 + r) % 2]) for r in range(2) for k in range(11)], "recording_id long, frame_idx long, label string")
    runs = S.runs(df, "label").orderBy("recording_id", "seg_idx").collect()
    for a, b in zip(runs, runs[1:]):
        if a.recording_id == b.recording_id:
            assert b.start_idx == a.end_idx + 1 and a.label != b.label


def test_short_segments_become_one_as_observed(spark):
    rows = [(1, 0.0, 2.0, 1), (1, 2.0, 0.2, 0), (1, 2.2, 1.0, 1), (1, 3.2, 0.1, 0)]
    df = spark.createDataFrame(rows, "recording_id long, start double, duration double, label int")
    out = S.cleaned(df, 0.5, 1).orderBy("start").collect()
    assert [(r.start, round(r.duration, 6), r.label) for r in out] == [(0.0, 3.2, 1), (3.2, 0.1, 0)]


def test_suppression_keeps_the_sum():
    x = np.random.default_rng(3).random(100)
    out = K.suppressed(x, 5)
    assert np.isclose(out.sum(), x.sum()) and len(np.flatnonzero(out)) < 40
    assert not K.suppressed(np.zeros(5), 5).any()


def test_recursive_cuts_keep_their_distance():
    def cuts(x, at):  # the rule by itself: the largest of the piece, then what lies beyond `least` on both sides
        if not len(x):
            return []
        i = max(range(len(x)), key=lambda k: (x[k], -k))
        return cuts(x[: max(0, i - 10)], at) + [at + i] + cuts(x[i + 11 :], at + i + 11)

    for seed in range(20):
        x = np.random.default_rng(seed).integers(0, 30, 10 * seed).astype(float)
        cut = np.flatnonzero(K.recursive_cuts(x, 10)).tolist()
        assert cut == cuts(x.tolist(), 0) and (len(cut) < 2 or np.diff(cut).min() > 10)
    assert K.recursive_cuts(np.ones(5), 10).tolist() == [1, 0, 0, 0, 0] and len(K.recursive_cuts(np.zeros(0), 3)) == 0


def test_divergence_finds_a_change():
    rng = np.random.default_rng(5)
    x = np.zeros(4000)
    for k in range(2, 4000):
        a = (1.6, -0.8) if k < 2000 else (-0.5, -0.6)
        x[k] = a[0] * x[k - 1] + a[1] * x[k - 2] + rng.normal()
    cuts = [c for c, _ in changepoints.segment(x, 1000.0)]
    assert any(abs(c - 2000) < 60 for c in cuts)
    assert changepoints.segment(np.zeros(500), 1000.0) == []
    assert changepoints.hybrid_segment(x[:500], 1000.0)[-1] == (500, 1)
    assert changepoints.segment(np.zeros(0), 1000.0) == [] and changepoints.hybrid_segment(np.zeros(0), 1000.0) == []


def test_bic_cuts_where_the_mean_moves():
    rng = np.random.default_rng(6)
    x = np.vstack((rng.normal(size=(200, 4)), 3 + rng.normal(size=(200, 4))))
    cuts = bic.growing_cuts(x, 1.0)
    assert cuts and min(abs(c - 200) for c in cuts) < 8
    owner = bic.cluster([x[:100], x[200:300], x[100:200], x[300:]], 1.0)
    assert owner == [0, 1, 0, 1]
    assert bic.cluster([x[:100], x[200:300], x[100:200], x[300:]], 1.0, full=True) == [0, 1, 0, 1]


def test_percentile_penalty():
    assert round(percentile_penalty(bic.PENALTIES), 3) == 2.805


def brute_viterbi(scores, penalty):
    import itertools

    n, units = scores.shape
    return max(sum(scores[t, u] for t, u in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(units), repeat=n))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(7)
    for _ in range(10):
        s = rng.normal(size=(6, 3))
        segments, score = viterbi_path(s, 0.7)
        assert np.isclose(score * 6, brute_viterbi(s, 0.7))
        assert sum(n for _, n, _ in segments) == 6
    long, _ = viterbi_path(rng.normal(size=(40, 3)), 0.1, duration=5)
    assert all(n >= 5 for _, n, _ in long[:-1])
    assert viterbi_path(np.zeros((0, 3)), 1.0) == ([], 0.0)


def test_pitch_of_tones():
    t = np.arange(800) / 16000
    c, f = G.pitch(np.sin(2 * np.pi * 440 * t), 16000, 60, 8000)
    assert abs(f - 440) < 8 and c < 0.3
    assert G.pitch(np.zeros(800), 16000, 60, 8000) == (1.0, 0.0)
    t = np.arange(200) / 50
    assert G.has_vibrato(220 + 5 * np.sin(2 * np.pi * 6 * t), 50.0) and not G.has_vibrato(220 + 5 * np.sin(2 * np.pi * 1 * t), 50.0)
    assert not G.has_vibrato(np.full(50, 3.0), 50.0)


def test_yin_difference_by_definition():
    x = np.random.default_rng(8).normal(size=60)
    d = G.yin_difference(x, 20)
    assert np.allclose(d, [sum((x[j] - x[j + k]) ** 2 for j in range(40)) for k in range(20)])
    n = G.yin_normalized(d)
    assert n[0] == 1 and np.isclose(n[5], d[5] * 5 / d[1:6].sum())


def test_band_weights_are_a_filter_along_bands():
    h, x = G.band_pass(20, 0.1, 0.4), np.random.default_rng(9).normal(size=20)
    assert np.isclose(np.convolve(x, h)[:20].sum(), G.band_weights(h, 20) @ x)


def test_feature_plans():
    name, steps = G.parse_plan("m1: MFCC CepsIgnoreFirstCoeff=0 blockSize=64 stepSize=32 > Derivate DOrder=2")
    assert name == "m1" and [s.name for s in steps] == ["MFCC", "Derivate"]
    x = np.random.default_rng(10).normal(size=1000)
    assert G.run_plan("z: ZCR blockSize=64 stepSize=32", x, 16000).shape == (30, 1)
    assert G.run_plan("m: MFCC CepsIgnoreFirstCoeff=0 blockSize=64 stepSize=32 > Derivate DOrder=1", x, 16000).shape == (30, 13)
    with pytest.raises(ValueError):
        G.parse_plan("no plan")


def test_tracks_follow_their_peaks():
    frames = [(t, [(440.0 + t, 1.0), (900.0, 0.5)] if t != 5 else [(445.0, 1.0)]) for t in range(12)]
    tracks = harmonic.track_peaks(frames, least=3)
    assert sorted(len(t) for t in tracks) == [5, 6, 12]
    groups = harmonic.harmonic_groups([[(t, 100.0 * k, 1.0) for t in range(5)] for k in (1, 2, 3)] + [[(t, 137.0, 1.0) for t in range(5)]])
    assert sorted(groups) == [(0, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0)]


def test_range_join_is_brute_force(spark):
    from runnel.operators import joins as J

    rng = np.random.default_rng(11)
    g, p = rng.uniform(0, 50, 40), rng.uniform(0, 50, 60)
    got = J.range_count(spark.createDataFrame([(1, float(t)) for t in g], "recording_id long, t double"), spark.createDataFrame([(1, float(t)) for t in p], "recording_id long, t double"), 1.5).toPandas()
    want = pd.Series({t: int((np.abs(p - t) <= 1.5).sum()) for t in g})
    assert got.set_index("t").n.sort_index().tolist() == want.sort_index().tolist()


def test_wav_round_trip(spark, tmp_path):
    import wave

    from runnel.sources.audio import frames, mono, read_wav

    x = (np.sin(np.arange(1000) / 9) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.stack((x, -x), 1).tobytes())
    blocks = read_wav(spark, str(tmp_path), block=300)
    assert blocks.count() == 4
    f = frames(mono(blocks), 256, 100).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in f] == list(range(8))
    assert np.allclose(f[3].samples, x[300:556] / 32768, atol=1e-6)
    assert np.allclose(mono(blocks, down_mix=True).first().samples, 0)


def test_log_sum_exp_does_not_overflow(spark):
    from runnel.operators.models import log_sum_exp

    values = {1: [-1000.0, -1001.0], 2: [900.0, 3.0, 900.0]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "k int, v double")
    got = {r.k: r.out for r in log_sum_exp(df, ["k"], "v", "out").collect()}
    assert got.keys() == values.keys() and all(abs(got[k] - np.logaddexp.reduce(x)) < 1e-9 for k, x in values.items())


def test_harmonicity_is_the_confidence_of_the_pitch():
    from runnel.functions.signal import harmonicity, pitch

    x = np.sin(2 * np.pi * 200 * np.arange(2048) / 8000)
    noise = np.random.default_rng(1).normal(size=2048)
    assert harmonicity(x, 8000, 60.0) == pitch(x, 8000, 60.0, 4000)[0] != harmonicity(noise, 8000, 60.0)
