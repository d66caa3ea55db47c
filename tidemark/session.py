"""Session settings the engine is written for, and the worker path."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for local use; a cluster's own settings stay as they are where they are set."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    for k, v in CONF.items():
        builder = builder.config(k, v)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver found it."""
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
