"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text are computed once and written. Each partition of labelled rows sums
its share of the normal equations; Spark adds the shares by cell, so what reaches the driver is one
matrix, whatever the number of rows. The calibration comes from a third of the labelled rows, which the
regression has not seen, summed over a fixed grid of scores before the monotone fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import documents, held_out, written
from runnel.llm.features import NAMES, described, isotonic, label_table, statistics

#: Random features, width of the kernel (in standard deviations), ridge penalty, grid of scores.
FEATURES, WIDTH, RIDGE, GRID = 96, 3.0, 1.0, 400


class Fourier:
    """cos(w z + b) features of standardized statistics: they approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(3)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def normal_equations(rows: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over rows (x, y): partitions sum, then cells are added up."""
    n = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for batch in batches:
            f = features(_matrix(batch))
            total += f.T @ np.hstack((f, batch.column("y").to_numpy()[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * (n + 1)), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    cells = rows.select("x", "y").mapInArrow(sums, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(n * (n + 1))
    for r in cells:
        total[r["cell"]] = r["v"]
    total = total.reshape(n, n + 1)
    return total[:, :n], total[:, n]


def scored(table: DataFrame, features: Fourier, weights: np.ndarray, curve: tuple[list, list] | None) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = features(_matrix(batch)) @ weights if batch.num_rows else np.zeros(0)
            if curve:
                s = np.clip(np.interp(s, *curve), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(s)], [*batch.schema.names, "score"])

    return table.mapInArrow(score, ", ".join(f"{c} {t}" for c, t in table.dtypes) + ", score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    labels: (doc_id, y) to learn from. Null and empty texts have all statistics 0 and get the
    score of that point. Without labels of both kinds every score is the share of 1 (0.5 where
    there are none). A null id is never learned from and not held out. Other columns are ignored.
    """
    table = written(described(docs, statistics, NAMES), "statistics")
    known = written(table.join(labels, "doc_id"), "labelled")
    held = F.coalesce(held_out("doc_id"), F.lit(False))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if ones in (0, n):
        done = table.withColumn("score", F.lit(ones / n if n else 0.5))
    else:
        moments = known.select(*[f(F.col("x")[k]).alias(f"{f.__name__}{k}") for k in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
        scale = np.array(moments[1::2])
        features = Fourier(np.array(moments[::2]), np.where(scale > 1e-9, scale, 1.0))
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
        a, b = normal_equations(known.where(~fold), features)
        weights = np.linalg.solve(a + RIDGE * np.eye(len(a)), b)
        grid = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "score")) * GRID) / GRID
        # at most 3 * GRID + 1 rows
        sums = scored(known.where(fold).select("x", "y"), features, weights, None).groupBy(grid.alias("s")).agg(F.count("*").cast("double"), F.sum("y")).collect()
        curve = isotonic([tuple(r) for r in sums]) if sums else ([0.0, 1.0], [0.0, 1.0])
        done = scored(table, features, weights, curve)
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored as ``labels.quality`` marks them."""
    return quality_scores(documents(spark, sf_dir), label_table(spark, sf_dir, "quality"))
