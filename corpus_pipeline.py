"""A corpus pipeline of five stages, each calling one operator of tracewright.llm; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import pipeline

STAGES = [
    ("language_id", pipeline.language_id),
    ("line_dedup", pipeline.dedup_lines),
    ("jaccard_join", pipeline.dedup_near),
    ("decontamination", pipeline.decontaminate),
    ("byte_bpe", pipeline.tokenize),
]

#: Language ID by a trained network can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    return pipeline.apply(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
