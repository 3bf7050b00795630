"""Recordings: reading PCM WAV files, waveforms, and cutting them into overlapping frames."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "recording_id string, block_idx long, sample_rate int, channels int, samples array<array<float>>"


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and (samples, channels) in [-1, 1] of an 8, 16, 24 or 32-bit PCM file."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        x = (v - ((v & 0x800000) << 1)) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)
    return rate, x.reshape(-1, channels)


def read_wav(spark: SparkSession, path: str, block: int = 16384) -> DataFrame:
    """Blocks of samples of all WAV files under ``path``; the recording is named by its file."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                rate, x = decode_wav(content)
                for k in range(0, max(1, len(x)), block):
                    yield pd.DataFrame({"recording_id": [name], "block_idx": [k // block], "sample_rate": [rate], "channels": [x.shape[1]], "samples": [x[k : k + block].astype(np.float32).tolist()]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(decode, BLOCKS)


def mono(blocks: DataFrame, down_mix: bool = False) -> DataFrame:
    """samples as array<double>: the first channel, or the mean of all."""
    one = (lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)) if down_mix else (lambda s: F.element_at(s, 1).cast("double"))
    return blocks.withColumn("samples", F.transform("samples", one))


def frames(blocks: DataFrame, size: int, step: int) -> DataFrame:
    """recording_id, frame_idx, t, samples: whole frames of mono blocks of equal length.

    A block takes the head of the next ones it needs, so frames are cut in parallel and no task
    sees a whole recording. Frames never reach past the end.
    """
    o = Window.partitionBy("recording_id").orderBy("block_idx")
    whole = Window.partitionBy("recording_id")
    b = blocks.withColumn("_n", F.max(F.size("samples")).over(whole))
    first = b.agg(F.min("_n"), F.max("_n")).first()
    if first[0] is None:
        reach = 0
    else:
        reach = -(-(size - 1) // max(1, first[0]))
    tail = F.concat("samples", *[F.coalesce(F.lead("samples", k).over(o), F.expr("cast(array() as array<double>)")) for k in range(1, reach + 1)])
    at = F.col("block_idx") * F.col("_n")
    begin = F.ceil(at / step) * step - at
    last = F.least(F.col("_n") - 1, F.size("_x") - size)
    cut = b.withColumn("_x", tail).withColumn("_o", F.when(begin <= last, F.sequence(begin, last.cast("long"), F.lit(step).cast("long"))))
    rows = cut.select("recording_id", "sample_rate", at.alias("_at"), "_x", F.explode("_o").alias("_k"))
    return rows.select("recording_id", ((F.col("_at") + F.col("_k")) / step).cast("long").alias("frame_idx"), ((F.col("_at") + F.col("_k")) / F.col("sample_rate")).alias("t"), F.slice("_x", (F.col("_k") + 1).cast("int"), size).alias("samples"))


def from_arrays(spark: SparkSession, recordings: dict[str, tuple[int, np.ndarray]], block: int = 4096) -> DataFrame:
    """Mono blocks of in-memory signals: name -> (rate, samples)."""
    rows = [(name, k // block, rate, 1, [float(v) for v in x[k : k + block]]) for name, (rate, x) in recordings.items() for k in range(0, len(x), block)]
    return spark.createDataFrame(rows, "recording_id string, block_idx long, sample_rate int, channels int, samples array<double>")


def onsets(blocks: DataFrame, rate: int, size: int = 1024, step: int = 256, limit: float = 1.5) -> DataFrame:
    """recording_id, t of rises of the spectral flux: local maxima over ``limit`` times the mean flux."""
    from runnel.functions.signal import spectrum
    from runnel.operators.topk import local_maxima

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf.samples.to_numpy()) if len(pdf) else np.zeros((0, size))
            s = spectrum(x, size, power=False)
            yield pd.DataFrame({"recording_id": pdf.recording_id, "frame_idx": pdf.frame_idx, "energy": s.sum(1)})

    o = Window.partitionBy("recording_id").orderBy("frame_idx")
    e = frames(blocks, size, step).mapInPandas(norms, "recording_id string, frame_idx long, energy double")
    flux = e.withColumn("flux", F.greatest(F.lit(0.0), F.col("energy") - F.coalesce(F.lag("energy").over(o), F.col("energy"))))
    mean = F.avg("flux").over(Window.partitionBy("recording_id"))
    strong = local_maxima(flux.withColumn("mean", mean), "flux").where(F.col("flux") > limit * F.col("mean"))
    return strong.select("recording_id", (F.col("frame_idx") * step / rate).alias("t"))
