"""The corpus pipeline: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, language_id, mixing, packing, shingle_dedup, toxicity

STAGES = [
    ("language_id", language_id.keep_identified),
    ("toxicity", toxicity.keep_clean),
    ("near_dedup", shingle_dedup.keep_one),
    ("mixing", mixing.repeat),
    ("packing", packing.stage),
]
#: Fitted models and seeded shuffles have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents; each result is written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = common.shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
