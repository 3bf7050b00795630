"""Runs, segments and interval algebra, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from runnel.operators.windows import by_frame

def by_start() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("start")


def runs(df: DataFrame, label: str) -> DataFrame:
    """recording_id, seg_idx, start_idx, end_idx (inclusive), label: the runs of equal labels."""
    changed = F.coalesce((F.lag(label).over(by_frame()) != F.col(label)).cast("int"), F.lit(1))
    marked = df.select("recording_id", "frame_idx", F.col(label).alias("label"), changed.alias("_c"))
    numbered = marked.withColumn("seg_idx", F.sum("_c").over(by_frame().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("recording_id", "seg_idx", "label").agg(F.min("frame_idx").alias("start_idx"), F.max("frame_idx").alias("end_idx"))


def timed(segments: DataFrame, step: float, inclusive: bool = True) -> DataFrame:
    """Adds start and duration in seconds; inclusive: a run's last frame counts in full."""
    frames = F.col("end_idx") - F.col("start_idx") + (1 if inclusive else 0)
    return segments.withColumn("start", F.col("start_idx") * step).withColumn("duration", frames * step)


def without_short_runs(df: DataFrame, flag: str, length: int, out: str) -> DataFrame:
    """Unsets set runs shorter than ``length``: what opening with a flat element does."""
    changed = F.coalesce((F.lag(flag).over(by_frame()) != F.col(flag)).cast("int"), F.lit(1))
    numbered = df.withColumn("_c", changed).withColumn("_r", F.sum("_c").over(by_frame().rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy("recording_id", "_r"))
    return numbered.withColumn(out, F.col(flag) & (size >= length)).drop("_c", "_r")


def merge_adjacent(segments: DataFrame) -> DataFrame:
    """Joins neighbours of one label: (recording_id, start, duration, label) rows."""
    changed = F.coalesce((F.lag("label").over(by_start()) != F.col("label")).cast("int"), F.lit(1))
    marked = segments.withColumn("_c", changed).withColumn("_r", F.sum("_c").over(by_start().rowsBetween(Window.unboundedPreceding, 0)))
    done = marked.groupBy("recording_id", "_r", "label").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("duration")).alias("_e"))
    return done.select("recording_id", "start", (F.col("_e") - F.col("start")).alias("duration"), "label")


def merge_speakers(segments: DataFrame) -> DataFrame:
    """Joins neighbours of one label across gaps: up to the end of the last member."""
    changed = F.coalesce((F.lag("label").over(by_start()) != F.col("label")).cast("int"), F.lit(1))
    marked = segments.withColumn("_c", changed).withColumn("_r", F.sum("_c").over(by_start().rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("start", (F.col("start") + F.col("duration")).alias("e")))
    done = marked.groupBy("recording_id", "_r", "label").agg(F.min("start").alias("start"), last.alias("_l"))
    return done.select("recording_id", "start", (F.col("_l.e") - F.col("start")).alias("duration"), "label")


def flip_short(segments: DataFrame, shortest: float = 0.5, to: int = 1, flip: bool = False) -> DataFrame:
    """Relabels interior segments shorter than ``shortest``: all to ``to``, or with flip to the other label."""
    row = F.row_number().over(by_start())
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    short = (row > 1) & (row < n) & (F.col("duration") < shortest)
    return segments.withColumn("label", F.when(short, (1 - F.col("label")) if flip else F.lit(to)).otherwise(F.col("label")))


def cleaned(segments: DataFrame, shortest: float = 0.5, to: int = 1) -> DataFrame:
    """Merge, relabel short segments, merge again."""
    return merge_adjacent(flip_short(merge_adjacent(segments), shortest, to))


def sessions(silences: DataFrame, ends: DataFrame, step: float) -> DataFrame:
    """Tiles a recording by accepted silences (recording_id, s0, s1 in frames): session, start, session, ...

    ends: recording_id, n_frames. label 0 is a start (the silence), 1 a session; empty sessions go.
    """
    o = Window.partitionBy("recording_id").orderBy("s0")
    before = silences.select("recording_id", (F.coalesce(F.lag("s1").over(o), F.lit(0)) * step).alias("start"), (F.col("s0") * step).alias("_e"), F.lit(1).alias("label"))
    starts = silences.select("recording_id", (F.col("s0") * step).alias("start"), (F.col("s1") * step).alias("_e"), F.lit(0).alias("label"))
    last = silences.groupBy("recording_id").agg(F.max("s1").alias("s1"))
    tail = ends.join(last, "recording_id", "left").select("recording_id", (F.coalesce("s1", F.lit(0)) * step).alias("start"), (F.col("n_frames") * step).alias("_e"), F.lit(1).alias("label"))
    every = before.unionByName(starts).unionByName(tail)
    return every.where("_e > start").select("recording_id", "start", (F.col("_e") - F.col("start")).alias("duration"), "label")


def alternating(boundaries: DataFrame, at: str = "t") -> DataFrame:
    """Intervals between successive boundaries, with alternating labels from 0."""
    o = Window.partitionBy("recording_id").orderBy(at)
    rows = boundaries.select("recording_id", F.col(at).alias("start"), (F.lead(at).over(o) - F.col(at)).alias("duration"), ((F.row_number().over(o) - 1) % 2).cast("int").alias("label"))
    return rows.where("duration is not null")


def chunks(frames: DataFrame, cut: str, gap: int = 1) -> DataFrame:
    """chunk_id, first_idx, last_idx, n: a new chunk at each cut and after each gap of frames."""
    new = F.when(F.col(cut) | (F.col("frame_idx") - F.lag("frame_idx").over(by_frame()) > gap), 1).otherwise(0)
    marked = frames.withColumn("_n", new).withColumn("chunk_id", F.sum("_n").over(by_frame().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("recording_id", "chunk_id").agg(F.min("frame_idx").alias("first_idx"), F.max("frame_idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))


def ruptures(times: DataFrame, at: str = "t") -> DataFrame:
    """(start, stop) of consecutive times, the first from 0."""
    o = Window.partitionBy("recording_id").orderBy(at)
    return times.select("recording_id", F.coalesce(F.lag(at).over(o), F.lit(0)).alias("start"), F.col(at).alias("stop"))


def notes(df: DataFrame, pitch: str, ratio: float = 2 ** (1 / 12)) -> DataFrame:
    """Adds ``note``: a new one starts where the pitch leaves the last frame's by over a half tone.

    The ratio is the larger by the smaller pitch, 0 where one is not positive. The comparison that
    would start a note at a series' last frame is not made.
    """
    before = F.lag(pitch).over(by_frame())
    leap = F.when(F.least(before, F.col(pitch)) > 0, F.greatest(before, F.col(pitch)) / F.nullif(F.least(before, F.col(pitch)), F.lit(0.0))).otherwise(0.0)
    last = F.lead("frame_idx").over(by_frame()).isNull()
    new = F.when((leap > ratio) & ~last, 1).otherwise(0)
    return df.withColumn("_n", new).withColumn("note", F.sum("_n").over(by_frame().rowsBetween(Window.unboundedPreceding, 0))).drop("_n")
