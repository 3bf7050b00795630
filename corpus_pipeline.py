"""The corpus pipeline: stages that each call one corpus operator over all that is left.

``run`` applies them to the documents. Every stage writes what it needs to read twice into the
shared folder, and deletes what earlier stages left there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import documents, free_name, stage_scope, written
from runnel.llm.features import label_table
from runnel.llm.op2_pii import redacted
from runnel.llm.op5_lsh_forest import near_duplicates
from runnel.llm.op6_toxicity import toxicity_scores
from runnel.llm.op9_decontamination import contaminated
from runnel.llm.op10_packing import pack


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows of these ids (column doc_id); rows with a null id stay."""
    name = free_name(docs, "__gone")
    gone = rejected.select(F.col("doc_id").cast("long").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. An id with several rows goes if one of them does; rows
    with a null id stay. All columns are kept."""
    with stage_scope(spark, docs):
        scores = toxicity_scores(docs, label_table(spark, sf_dir, "toxic"))
        return _without(docs, scores.where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the
    least id stays. Texts without words and rows with a null id stay; of rows that share an id and
    are near-duplicates of nothing with a lesser id, all stay."""
    with stage_scope(spark, docs):
        return _without(docs, near_duplicates(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null id stay."""
    with stage_scope(spark, docs):
        return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data is replaced by its kind in brackets."""
    with stage_scope(spark, docs):
        return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows of 2048 ids: one row per piece."""
    with stage_scope(spark, docs):
        return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Model training, signatures and tokenization are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read by the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
