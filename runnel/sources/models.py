"""Model and prototype tables, and the result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GMM = "model_id string, k int, weight double, mu array<double>, var array<double>"


def read_gmm(spark: SparkSession, path: str) -> DataFrame:
    """Mixtures of diagonal Gaussians, as Parquet; there are no executable model files."""
    return spark.read.schema(GMM).parquet(path)


def read_prototype(spark: SparkSession, path: str) -> list[float]:
    """A one-row table (shape array<double>)."""
    return list(spark.read.parquet(path).select("shape").limit(1).first()[0])


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """One folder for each result id."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/result_id={name}")
