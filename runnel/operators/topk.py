"""Local maxima, top-k per frame, and greedy peak selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runnel.operators.windows import by_frame


def local_maxima(df: DataFrame, value: str) -> DataFrame:
    """Rows above both neighbours; the ends have only one and go."""
    before, after = F.lag(value).over(by_frame()), F.lead(value).over(by_frame())
    return df.withColumn("_k", (F.col(value) > before) & (F.col(value) > after)).where("_k").drop("_k")


def top_k(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k largest values of each group, ties by the lesser ``tie``, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), tie))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def suppressed(density: np.ndarray, reach: int) -> np.ndarray:
    """Greedy non-maximum suppression: the largest value gathers rows [i - reach, i + reach), which
    are then emptied, until nothing is left. Of equal values the first counts."""
    left, out = density.astype(float).copy(), np.zeros(len(density))
    while len(left) and left.max() > 0:
        i = int(left.argmax())
        lo, hi = max(0, i - reach), min(len(left), i + reach)
        out[i] = left[lo:hi].sum()
        left[lo:hi] = 0
    return out


def recursive_cuts(data: np.ndarray, least: int) -> np.ndarray:
    """0/1 per frame: the largest value of a piece cuts (the first of equal ones), ``least`` frames
    before it and as many after it are closed, and what is left on both sides goes on. So every
    series that is not empty has a cut, wherever its largest value is."""
    cut = np.zeros(len(data), int)
    stack = [(0, len(data))]
    while stack:
        lo, hi = stack.pop()
        if hi <= lo:
            continue
        i = lo + int(np.argmax(data[lo:hi]))
        cut[i] = 1
        stack += [(lo, i - least), (i + least + 1, hi)]
    return cut


def per_recording(df: DataFrame, value: str, function, out: str, *args) -> DataFrame:
    """Adds ``out`` = function(values of a recording in order): for recursions that need the whole of it."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        return pdf.assign(**{out: np.asarray(function(pdf[value].to_numpy(), *args), float)})

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + f", {out} double"
    return df.groupBy("recording_id").applyInPandas(apply, schema)
