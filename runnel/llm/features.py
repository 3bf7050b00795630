"""Dense statistics of whole texts, and isotonic calibration of scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import fresh_worker, held_out

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = np.frombuffer(b".,;:!?\"'()-", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>=_~^@/\\{}[]+", np.uint8)

NAMES = [
    "log_words", "word_bytes", "distinct", "top_share", "upper", "digits", "marks", "symbols", "bangs", "pipes", "non_ascii", "controls",
    "line_words", "repeated_lines", "ended_lines", "long_words", "one_byte_words", "vowels",
]


def statistics(text: bytes | None) -> np.ndarray:
    """Numbers that describe a text's form; all 0 where it has no word."""
    words = text.split() if text else []
    if not words:
        return np.zeros(len(NAMES))
    n, size = len(words), len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    lengths = np.fromiter(map(len, words), np.int32, n)
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return np.array([
        np.log(n), lengths.mean(), len(times) / n, max(times.values()) / n, count[_UPPER].sum() / letters, count[_DIGIT].sum() / size,
        count[_MARKS].sum() / n, min(3.0, count[_SYMBOLS].sum() / n), min(3.0, count[33] / n), min(3.0, count[124] / n), (count[128:].sum()) / size, count[:9].sum() / size,
        np.log(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in b".!?" for x in lines) / len(lines), (lengths > 15).mean(), (lengths == 1).mean(),
        count[np.frombuffer(b"aeiouAEIOU", np.uint8)].sum() / letters,
    ])


def described(docs: DataFrame, function, names: list[str]) -> DataFrame:
    """(doc_id, row, x): a vector of statistics for each row of ``docs``; row tells rows of one id apart."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = np.array([function(t) for t in part.column(1).to_pylist()], np.float64).reshape(part.num_rows, len(names))
                ends = pa.array(np.arange(0, x.size + 1, len(names)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "x"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return kept.mapInArrow(describe, "doc_id long, x array<double>")


def label_table(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(doc_id, y): labels that may be learned from. Rows without an id or label are left out, and
    an id's repeated labels count once, as 1 if half of them are."""
    table = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y"))
    return table.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))


def isotonic(sums: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators on (score, weight, sum of labels) rows: scores and rising values."""
    blocks: list[list[float]] = []
    for score, weight, total in sorted(sums):
        blocks.append([score, score, weight, total])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs, ys = [], []
    for lo, hi, weight, total in blocks:
        for x in dict.fromkeys((lo, hi)):
            xs.append(x)
            ys.append(total / weight)
    return xs, ys
