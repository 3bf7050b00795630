"""Streams of sample blocks: re-blocking into frames, running filters, tracks and runs.

State is kept per recording. A recording ends with a row whose ``last`` is set; what needs the end
(the open run, the live tracks) is given out then. Save for ``reblock``, which keeps early blocks, a
recording's rows come in order from trigger to trigger; within one they may come in any.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runnel.operators.harmonic import distance


def _in_order(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """All rows of one recording and trigger, which may come in several batches, sorted."""
    return pd.concat(list(batches)).sort_values(list(by), kind="stable")


def reblock(blocks: DataFrame, size: int, step: int) -> DataFrame:
    """recording_id, frame_idx, samples: hopping frames of a stream of (recording_id, block_idx, samples).

    Samples that no full frame has used yet wait in the state, and so do blocks that come before
    their turn.
    """

    def cut(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, frame, due, early = pickle.loads(state.get[0]) if state.exists else (np.zeros(0), 0, 0, {})
        for pdf in batches:
            early.update(zip(pdf.block_idx.tolist(), pdf.samples))
        while due in early:
            tail = np.concatenate((tail, np.asarray(early.pop(due), float)))
            due += 1
        out = []
        while len(tail) >= size:
            out.append((key[0], frame, tail[:size].tolist()))
            tail, frame = tail[step:], frame + 1
        state.update((pickle.dumps((tail, frame, due, early)),))
        yield pd.DataFrame(out, columns=["recording_id", "frame_idx", "samples"])

    kind = dict(blocks.dtypes)["recording_id"]
    return blocks.groupBy("recording_id").applyInPandasWithState(cut, f"recording_id {kind}, frame_idx long, samples array<double>", "s binary", "append", GroupStateTimeout.NoTimeout)


def filtered(frames: DataFrame, taps: list[float]) -> DataFrame:
    """recording_id, frame_idx, energy: root mean square after a filter whose memory goes from frame to frame."""
    from runnel.functions.signal import fir

    h = np.asarray(taps)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = np.asarray(state.get[0]) if state.exists else None
        out = []
        for r in _in_order(batches, "frame_idx").itertuples():
            y, memory = fir(h, np.asarray(r.samples, float), memory)
            out.append((key[0], r.frame_idx, float(np.sqrt((y**2).mean()))))
        if memory is not None:
            state.update((memory.tolist(),))
        yield pd.DataFrame(out, columns=["recording_id", "frame_idx", "energy"])

    kind = dict(frames.dtypes)["recording_id"]
    return frames.groupBy("recording_id").applyInPandasWithState(run, f"recording_id {kind}, frame_idx long, energy double", "m array<double>", "append", GroupStateTimeout.NoTimeout)


def running_runs(frames: DataFrame) -> DataFrame:
    """recording_id, start_idx, end_idx, label of each finished run of (frame_idx, label, last) rows."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        out = []
        for r in _in_order(batches, "frame_idx").itertuples():
            if open_ is not None and open_[2] == r.label:
                open_ = (open_[0], r.frame_idx, r.label)
            else:
                if open_ is not None:
                    out.append((key[0], *open_))
                open_ = (r.frame_idx, r.frame_idx, r.label)
            if r.last:
                out.append((key[0], *open_))
                open_ = None
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(open_[0]), int(open_[1]), str(open_[2])))
        yield pd.DataFrame(out, columns=["recording_id", "start_idx", "end_idx", "label"])

    kind = dict(frames.dtypes)["recording_id"]
    return frames.groupBy("recording_id").applyInPandasWithState(run, f"recording_id {kind}, start_idx long, end_idx long, label string", "a long, b long, label string", "append", GroupStateTimeout.NoTimeout)


def tracked(peaks: DataFrame, least: int = 5) -> DataFrame:
    """recording_id, start_idx, end_idx, n of each finished track of (frame_idx, rank, frequency, amplitude, last) peaks."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = pickle.loads(state.get[0]) if state.exists else []
        out = []
        for t, g in _in_order(batches, "frame_idx", "rank").groupby("frame_idx", sort=True):
            left, keep = [(f, a) for f, a in zip(g.frequency, g.amplitude) if f > 0 and a > 0], []
            for start, n, f0, a0, end in live:
                k = next((i for i, (f, a) in enumerate(left) if distance(f, a, f0, a0) < 1), None)
                if k is not None:
                    keep.append((start, n + 1, *left.pop(k), t))
                elif n > least:
                    out.append((key[0], start, end, n))
            live = keep + [(t, 1, f, a, t) for f, a in left]
            if g["last"].any():
                out += [(key[0], s, e, n) for s, n, _, _, e in live if n > least]
                live = []
        state.update((pickle.dumps(live),))
        yield pd.DataFrame(out, columns=["recording_id", "start_idx", "end_idx", "n"])

    kind = dict(peaks.dtypes)["recording_id"]
    return peaks.groupBy("recording_id").applyInPandasWithState(run, f"recording_id {kind}, start_idx long, end_idx long, n long", "s binary", "append", GroupStateTimeout.NoTimeout)


def hopping_counts(events: DataFrame, length: str, hop: str, late: str = "10 minutes") -> DataFrame:
    """Counts in event-time windows; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy("recording_id", F.window("ts", length, hop)).count()


def replay(source, query: str):
    """Runs a streaming DataFrame over all that its source holds now, into a table in memory."""
    q = source.writeStream.format("memory").queryName(query).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return source.sparkSession.table(query)
