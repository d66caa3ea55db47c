"""The queries of this subpackage for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fingerprints, language_id, licenses, lm_scoring, mixing, near_dedup, packing, sharding, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_top_k": topk.query,
        "op2_document_fingerprints": fingerprints.query,
        "op3_packing": packing.query,
        "op4_sharding": sharding.query,
        "op5_source_mixing": mixing.query,
        "op6_simhash_near_dedup": near_dedup.query,
        "op7_language_id": language_id.query,
        "op8_toxicity": toxicity.query,
        "op9_license_scan": licenses.query,
        "op10_lm_scoring": lm_scoring.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": topk.SQL}
