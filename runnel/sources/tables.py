"""Series, feature matrices, boundaries and nodes drawn from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts"):
    """Seconds since 1970 as a double, with microseconds."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame_idx, t, value, label: one series of events for each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), seconds().alias("t"), "value", F.col("event_type").alias("label"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame_idx, f, label: the embeddings as one recording's feature matrix."""
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("recording_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("f"), "label")


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame_idx, dim, x, label: a row per dimension."""
    return features(spark, sf_dir).select("recording_id", "frame_idx", "label", F.posexplode("f").alias("dim", "x"))


def boundaries(spark: SparkSession, sf_dir: str, label: str = "click") -> DataFrame:
    """recording_id, t, weight: the events of one type, in seconds."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == label).select(F.col("user_id").alias("recording_id"), seconds().alias("t"), F.col("value").alias("weight"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, track_id, frame_idx, frequency, amplitude: sinusoid-like nodes from line items."""
    day = Window.partitionBy("l_suppkey").orderBy("l_shipdate")
    track = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4) + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recording_id"), track.cast("long").alias("track_id"), F.dense_rank().over(day).cast("long").alias("frame_idx"), F.col("l_extendedprice").alias("frequency"), F.col("l_quantity").alias("amplitude"))


#: The same in SQL, as common table expressions.
SERIES = "series AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, epoch_us(ts) / 1e6 AS t, value, event_type AS label FROM events)"
LONG = "long AS (SELECT 0::BIGINT AS recording_id, vec_id AS frame_idx, label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
BOUNDARIES = "boundaries AS (SELECT user_id AS recording_id, epoch_us(ts) / 1e6 AS t, value AS weight FROM events WHERE event_type = 'click')"
NODES = "nodes AS (SELECT l_suppkey AS recording_id, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END)::BIGINT AS track_id, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS frame_idx, l_extendedprice AS frequency, l_quantity AS amplitude FROM lineitem)"
