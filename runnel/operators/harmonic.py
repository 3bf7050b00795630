"""Sinusoidal partials: tracking peaks, grouping tracks, vibrato; and graph components."""

from __future__ import annotations

import math
import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distance(f1: float, a1: float, f2: float, a2: float, cf: float = 100.0, cp: float = 3.0) -> float:
    return math.hypot(1200 * math.log2(f1 / f2) / cf, math.log10(a1 / a2) / cp)


def track_peaks(frames: list[tuple[int, list[tuple[float, float]]]], least: int = 5, skip: bool = False) -> list[list[tuple[int, float, float]]]:
    """Tracks of (frame, frequency, amplitude) nodes from frames of (frequency, amplitude) peaks.

    Tracks, in the order they began, take the first peak nearer than 1 to their last node; a track
    without one ends, and stays if it has more than ``least`` nodes. Other peaks begin tracks. skip
    leaves out the track after one that ended, as removal inside a running loop would.
    """
    live: list[list] = []
    done: list[list] = []
    for t, peaks in frames:
        peaks, keep, ended = [p for p in peaks if p[0] > 0 and p[1] > 0], [], False
        for track in live:
            if skip and ended:
                keep.append(track)
                ended = False
                continue
            k = next((i for i, (f, a) in enumerate(peaks) if distance(f, a, track[-1][1], track[-1][2]) < 1), None)
            if k is None:
                ended = True
                if len(track) > least:
                    done.append(track)
            else:
                track.append((t, *peaks.pop(k)))
                keep.append(track)
        live = keep + [[(t, f, a)] for f, a in peaks]
    return done + [x for x in live if len(x) > least]


def track(peaks: DataFrame, least: int = 5) -> DataFrame:
    """recording_id, track_id, frame_idx, frequency, amplitude from peaks with a rank; a recording is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_idx", "rank"])
        frames = [(t, list(zip(g.frequency, g.amplitude))) for t, g in pdf.groupby("frame_idx", sort=True)]
        rows = [(pdf.recording_id.iloc[0], k, *n) for k, tr in enumerate(track_peaks(frames, least)) for n in tr]
        return pd.DataFrame(rows, columns=["recording_id", "track_id", "frame_idx", "frequency", "amplitude"])

    kind = dict(peaks.dtypes)["recording_id"]
    return peaks.groupBy("recording_id").applyInPandas(run, f"recording_id {kind}, track_id long, frame_idx long, frequency double, amplitude double")


def components(edges: DataFrame) -> DataFrame:
    """recording_id, node, component: the least node that a chain of edges (recording_id, a, b) reaches.

    Labels spread along edges and jump to their label's label, so rounds grow with the logarithm
    of a chain's length. Each round ends in a checkpoint, which the executors share.
    """
    sc = edges.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = edges.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="runnel-")
        sc.setCheckpointDir(folder)
    both = edges.select("recording_id", "a", "b").union(edges.select("recording_id", F.col("b"), F.col("a"))).distinct().checkpoint()
    now = both.groupBy("recording_id", F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")).checkpoint()
    last = None
    while True:  # labels only ever fall
        met = both.join(now, (both.recording_id == now.recording_id) & (both.b == now.node)).select(both.recording_id, F.col("a").alias("node"), "component")
        spread = met.union(now.select("recording_id", "node", "component")).groupBy("recording_id", "node").agg(F.min("component").alias("component"))
        jump = spread.select("recording_id", F.col("node").alias("component"), F.col("component").alias("_c"))
        now = spread.join(jump, ["recording_id", "component"]).select("recording_id", "node", F.least("component", "_c").alias("component")).checkpoint()
        total = now.agg(F.sum("component"), F.sum(F.xxhash64("recording_id", "node", "component").cast("decimal(38,0)"))).first()
        if total == last:
            break
        last = total
    return now


def harmonic_groups(tracks: list[list[tuple[int, float, float]]]) -> list[tuple[int, int, float]]:
    """(track, group, rank): from the lowest track up, tracks at whole multiples of a root join it.

    The rank is the mean frequency ratio over common frames, rounded to quarters; only whole ranks
    count. A group has more than one track.
    """
    order = sorted(range(len(tracks)), key=lambda k: np.mean([f for _, f, _ in tracks[k]]))
    left, out, group = list(order), [], 0
    while left:
        root = left.pop(0)
        base = {t: f for t, f, _ in tracks[root]}
        mine = [(root, 1.0)]
        for k in left:
            ratios = [4 * f / base[t] for t, f, _ in tracks[k] if t in base]
            rank = math.floor(np.mean(ratios) + 0.5) / 4 if ratios else 0.5
            if rank == int(rank) and rank >= 1:
                mine.append((k, rank))
        if len(mine) > 1:
            out += [(k, group, rank) for k, rank in mine]
            group += 1
            taken = {k for k, _ in mine}
            left = [k for k in left if k not in taken]
    return out


def loudest(nodes: DataFrame) -> DataFrame:
    """The loudest node of each (recording, group, rank, frame), the lower frequency on ties: tracks of one rank as one."""
    best = F.max(F.struct("amplitude", (-F.col("frequency")).alias("m"))).alias("b")
    return nodes.groupBy("recording_id", "group", "rank", "frame_idx").agg(best).select("recording_id", "group", "rank", "frame_idx", (-F.col("b.m")).alias("frequency"), F.col("b.amplitude").alias("amplitude"))


def group_tracks(nodes: DataFrame) -> DataFrame:
    """recording_id, track_id, group, rank of the tracks of each component; nodes carry ``component``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.track_id.unique())
        tracks = [list(zip(g.frame_idx, g.frequency, g.amplitude)) for _, g in pdf.sort_values("frame_idx").groupby("track_id", sort=True)]
        rows = [(pdf.recording_id.iloc[0], ids[k], int(pdf.component.iloc[0]), g, float(r)) for k, g, r in harmonic_groups(tracks)]
        return pd.DataFrame(rows, columns=["recording_id", "track_id", "component", "group", "rank"])

    kind = dict(nodes.dtypes)["recording_id"]
    return nodes.groupBy("recording_id", "component").applyInPandas(run, f"recording_id {kind}, track_id long, component long, group long, rank double")
