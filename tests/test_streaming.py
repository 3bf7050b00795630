import numpy as np
from pyspark.sql import functions as F

from runnel.sources.audio import frames, from_arrays
from runnel.streaming import frames as T


def test_reblocking_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=1000)
    blocks = from_arrays(spark, {"a": (8000, x), "b": (8000, x[:700])}, block=90)
    for k in range(3):
        blocks.where(F.col("block_idx") % 3 == 2 - k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.replay(T.reblock(stream, 64, 40), "reblocked").orderBy("recording_id", "frame_idx").collect()
    want = frames(blocks, 64, 40).orderBy("recording_id", "frame_idx").collect()
    assert [(r.recording_id, r.frame_idx) for r in got] == [(r.recording_id, r.frame_idx) for r in want]
    assert all(np.allclose(a.samples, b.samples) for a, b in zip(got, want))


def test_runs_stream(spark, tmp_path):
    labels = "aabbbacccc"
    rows = [(1, k, c, k == len(labels) - 1) for k, c in enumerate(labels)]
    df = spark.createDataFrame(rows, "recording_id long, frame_idx long, label string, last boolean")
    for lo in (0, 4):
        df.where(f"frame_idx >= {lo} and frame_idx < {lo + 4 if lo == 0 else 99}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) == 2
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.replay(T.running_runs(stream), "runs").orderBy("start_idx").collect()
    assert [(r.start_idx, r.end_idx, r.label) for r in got] == [(0, 1, "a"), (2, 4, "b"), (5, 5, "a"), (6, 9, "c")]


def in_files(spark, tmp_path, rows, schema, column, cuts):
    """A stream of ``rows``, in one file for each interval of ``column`` between ``cuts``."""
    df = spark.createDataFrame(rows, schema)
    for lo, hi in zip(cuts, cuts[1:]):
        df.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_filter_carries_its_memory_over_frames_and_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    x, taps = {k: rng.normal(size=(9, 50)) for k in (1, 2)}, [0.5, 0.25, -0.25, 0.1]
    rows = [(k, i, f.tolist()) for k, v in x.items() for i, f in enumerate(v)]
    stream = in_files(spark, tmp_path, rows, "recording_id long, frame_idx long, samples array<double>", "frame_idx", [0, 3, 4, 9])
    got = {(r.recording_id, r.frame_idx): r.energy for r in T.replay(T.filtered(stream, taps), "filtered").collect()}
    whole = {k: np.convolve(v.ravel(), taps)[: v.size].reshape(v.shape) for k, v in x.items()}
    want = {(k, i): float(np.sqrt((f**2).mean())) for k, v in whole.items() for i, f in enumerate(v)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tracks_go_on_over_batches(spark, tmp_path):
    tones = {440.0: range(0, 12), 900.0: range(3, 10), 2000.0: range(5, 8)}
    rows = [(1, i, k, f, 1.0, i == 11) for i in range(12) for k, f in enumerate(f for f, at in tones.items() if i in at)]
    stream = in_files(spark, tmp_path, rows, "recording_id long, frame_idx long, rank int, frequency double, amplitude double, last boolean", "frame_idx", [0, 4, 7, 12])
    got = sorted(tuple(r) for r in T.replay(T.tracked(stream), "tracked").collect())
    assert got == [(1, 0, 11, 12), (1, 3, 9, 7)]


def test_hopping_windows_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(k % 2, start + timedelta(minutes=7 * k)) for k in range(60)]
    cuts = [start, start + timedelta(hours=2), start + timedelta(hours=4), start + timedelta(hours=9)]
    stream = in_files(spark, tmp_path, rows, "recording_id long, ts timestamp", "ts", cuts)
    got = {(r.recording_id, r.window.start): r["count"] for r in T.replay(T.hopping_counts(stream, "60 minutes", "30 minutes"), "hopping").collect()}
    want = {}
    for k, ts in rows:
        at = start - timedelta(minutes=60)
        while at <= ts:
            if at <= ts < at + timedelta(minutes=60):
                want[k, at] = want.get((k, at), 0) + 1
            at += timedelta(minutes=30)
    closed = {k: n for k, n in want.items() if k[1] + timedelta(minutes=60) <= rows[-1][1] - timedelta(minutes=10)}
    assert got == closed and len(got) > 20


def test_runs_of_one_trigger_in_several_batches(spark, tmp_path):
    """A trigger's rows reach a recording's function in small batches, and out of order."""
    labels = "".join(c * 5 for c in "abcabcab")
    rows = [(1, k, c, k == len(labels) - 1) for k, c in enumerate(labels)]
    stream = in_files(spark, tmp_path, rows[::-1], "recording_id long, frame_idx long, label string, last boolean", "frame_idx", [0, 99])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = T.replay(T.running_runs(stream), "runs_in_batches").orderBy("start_idx").collect()
    finally:
        spark.conf.set(name, before)
    assert [(r.start_idx, r.end_idx, r.label) for r in got] == [(5 * k, 5 * k + 4, c) for k, c in enumerate("abcabcab")]
