import numpy as np
import pytest

from runnel.plans import analyzers as A
from runnel.plans.graphers import GRAPHERS
from runnel.sources.audio import from_arrays


def demo(spark, rate=16000, seconds=4.0):
    """Blocks of three synthetic recordings: a vibrato tone, modulated noise, and tones that change."""
    t = np.arange(int(rate * seconds)) / rate
    rng = np.random.default_rng(1)
    voice = 0.5 * np.sin(2 * np.pi * 220 * t + 4 * np.sin(2 * np.pi * 5 * t))
    noise = 0.2 * rng.normal(size=len(t)) * (1 + np.sin(2 * np.pi * 4 * t))
    tones = 0.4 * np.sin(2 * np.pi * np.repeat([300, 500, 800, 400], len(t) // 4) * t[: len(t) // 4 * 4]) + 0.01 * rng.normal(size=len(t) // 4 * 4)
    return from_arrays(spark, {"voice": (rate, voice), "noise": (rate, noise), "tones": (rate, tones)})


def test_result_names_and_order(spark):
    out = A.run("irit_speech_4hz", A.Context(demo(spark, seconds=3.0), 16000))
    assert list(out) == ["irit_speech_4hz.energy_confidence", "irit_speech_4hz.segments", "irit_speech_4hz.segments_median"]
    rows = out["irit_speech_4hz.segments"].orderBy("recording_id", "start").collect()
    for a, b in zip(rows, rows[1:]):
        if a.recording_id == b.recording_id:
            assert abs(a.start + a.duration - b.start) < 1e-9 and a.label != b.label


def test_from_wav_files_to_written_results(spark, tmp_path):
    """Files are read, analysed and the results written, and give what the same samples give from memory."""
    import wave

    from runnel.sources.audio import decode_wav, mono, read_wav
    from runnel.sources.models import write_results

    rate, rng = 16000, np.random.default_rng(2)
    t = np.arange(rate * 2) / rate
    signals = {"speech": 0.2 * rng.normal(size=len(t)) * (1 + np.sin(2 * np.pi * 4 * t)) / 2, "tone": 0.5 * np.sin(2 * np.pi * 440 * t)}
    for name, x in signals.items():
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.repeat(np.clip(x * 32767, -32768, 32767).astype("<i2"), 2).tobytes())
    out = A.run("irit_speech_4hz", A.Context(mono(read_wav(spark, str(tmp_path))), rate))
    write_results(out, str(tmp_path / "results"))
    memory = {n: (rate, decode_wav((tmp_path / f"{n}.wav").read_bytes())[1][:, 0].astype(np.float32)) for n in signals}
    want = A.run("irit_speech_4hz", A.Context(from_arrays(spark, memory, block=16384), rate))
    assert len(out) == 3
    for name, df in want.items():
        def rows(frame):
            return sorted((r["recording_id"].rpartition("/")[2].removesuffix(".wav"), *(round(v, 6) if isinstance(v, float) else v for c, v in r.asDict().items() if c != "recording_id")) for r in frame.collect())

        back = spark.read.parquet(str(tmp_path / "results" / f"result_id={name}"))
        assert rows(back.select(df.columns)) == rows(df) != []


def test_one_voice_and_several(spark):
    """A harmonic tone is one voice at its pitch; four detuned ones in noise are not."""
    rate = 16000
    t = np.arange(rate * 3) / rate
    one = 0.5 * np.sin(2 * np.pi * 220 * t) + 0.2 * np.sin(2 * np.pi * 440 * t)
    drift = 1 + 0.01 * np.sin(2 * np.pi * 0.7 * t)
    many = sum(0.2 * np.sin(2 * np.pi * f * t * drift) for f in (220, 277.2, 331.3, 415.9)) + 0.1 * np.random.default_rng(5).normal(size=len(t))
    out = A.run("irit_monopoly", A.Context(from_arrays(spark, {"one": (rate, one), "many": (rate, many)}), rate))
    segments = {(r.recording_id, r.label_name) for r in out["irit_monopoly.segments"].collect()}
    assert segments == {("one", "Mono"), ("many", "Poly")}
    pitch = [r.f0 for r in out["irit_monopoly.pitch"].where("recording_id = 'one'").collect()]
    assert len(pitch) > 100 and np.allclose(pitch, 220, atol=3)


@pytest.mark.parametrize("name", ["irit_diverg", "irit_diverg2"])
def test_divergence_cuts_where_tones_change(spark, name):
    rate, rng = 16000, np.random.default_rng(5)
    t = np.arange(rate // 2) / rate
    tones = np.concatenate([0.4 * np.sin(2 * np.pi * f * t) for f in (300, 1500, 500)]) + 0.01 * rng.normal(size=3 * len(t))
    out = A.run(name, A.Context(from_arrays(spark, {"tones": (rate, tones)}), rate))
    cuts = np.array(sorted(r.t for r in out[f"{name}.segments"].collect()))
    for change in (0.5, 1.0):
        assert np.abs(cuts - change).min() < 0.02
    assert name != "irit_diverg" or len(cuts) == 2


def test_model_tables(spark, tmp_path):
    from runnel.sources.models import read_gmm, read_prototype

    model = [("m", 0, 1.0, [0.0, 1.0], [1.0, 2.0]), ("m", 1, 0.5, [None, 1.0], [1.0, 2.0])]
    spark.createDataFrame(model, "model_id string, k int, weight double, mu array<double>, var array<double>").write.parquet(str(tmp_path / "gmm"))
    spark.createDataFrame([([0.5, -1.0],)], "shape array<double>").write.parquet(str(tmp_path / "shape"))
    assert sorted(map(tuple, read_gmm(spark, str(tmp_path / "gmm")).collect())) == model
    assert read_prototype(spark, str(tmp_path / "shape")) == [0.5, -1.0]


def test_all_analyzers_and_graphers():
    assert len(A.REGISTRY) == 17 and len(GRAPHERS) == 18
    assert {a for _, a, *_ in GRAPHERS} <= set(A.REGISTRY)


def test_parameters_are_checked(spark):
    ctx = A.Context(demo(spark, seconds=0.2), 16000)
    with pytest.raises(ValueError):
        A.run("irit_speech_4hz", ctx, medfilt_duration="long")
    with pytest.raises(ValueError):
        A.run("irit_speech_4hz", ctx, colour=1)
    with pytest.raises(ValueError):
        A.run("limsi_sad", A.Context(ctx.blocks, 8000))
    with pytest.raises(ValueError):
        A.run("limsi_sad", ctx)


def test_graphers_name_parameters_that_analyzers_take():
    for _, id, result, parameters, _ in GRAPHERS:
        assert result.partition(".")[0] == A.checked(id, parameters).id
    A.checked("limsi_sad", {"dllh_min": None, "dllh_max": 4})
    for wrong in ({"sad_model": "other"}, {"dews": "long"}, {"dews": None}, {"dllh_bounds": 1.0}):
        with pytest.raises(ValueError):
            A.checked("limsi_sad", wrong)


def test_sad_takes_the_named_model(spark):
    rng = np.random.default_rng(4)
    blocks = from_arrays(spark, {"a": (16000, rng.normal(size=16000))})

    def models(ids):
        return spark.createDataFrame([(n, 0, 1.0, [m] * 40, [5.0] * 40) for n, m in ids], "model_id string, k int, weight double, mu array<double>, var array<double>")

    def scores(gmm, **options):
        rows = A.run("limsi_sad", A.Context(blocks, 16000, gmm), **options)["limsi_sad.sad_lhh_diff"].orderBy("frame_idx").collect()
        return [r.value for r in rows]

    one, two = [("speech", 0.0), ("nonspeech", 3.0)], [("speech", 5.0), ("nonspeech", 0.0)]
    both = models([(f"etape.{n}", m) for n, m in one] + [(f"maya.{n}", m) for n, m in two])
    assert scores(both) == scores(models(one)) and scores(both, sad_model="maya") == scores(models(two)) != scores(both)
    free = scores(both, dllh_max=None)
    assert scores(both, dllh_min=-1.0, dllh_max=6.0) == [min(max(x, -1.0), 6.0) for x in free] != free
