"""Streams: closed bars with watermark and deduplication, a stateful CUSUM, and a partitioned sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ready

WATERMARK = "3 minutes"


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder for checkpoints and outputs: the shared one the cluster names, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith(("local[", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    base = base or "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The event table as a stream of files."""
    ready(spark)
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    source = rows.parquet(path) if is_dir else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, rule: str = "1 hour") -> DataFrame:
    """Closed bars: late events beyond the watermark are dropped, repeated ones are counted once, a bar is emitted when it is over."""
    once = events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", rule).alias("w"), F.col("event_type").alias("symbol")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("volume"), F.count("*").alias("trades")).select("symbol", F.col("w.end").cast("timestamp_ntz").alias("ts"), "high", "low", "volume", "trades")


def to_files(stream: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Run over what is there and read back what the exactly-once file sink holds."""
    spark = stream.sparkSession
    out = _scratch(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", _scratch(spark, f"{name}-state")).option("path", out).trigger(availableNow=True)
    (writer.partitionBy(*by) if by else writer).start().awaitTermination()
    return spark.read.parquet(out)


def closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_files(bars(events_stream(spark, sf_dir)), "bars")


def cusum_update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """S = max(0, S + value - mean - k) for each symbol; the state is (S, rows seen). Rows of a trigger are taken in order of time."""
    s, n = state.get if state.exists else (0.0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for ts, value in zip(rows["ts"], rows["value"], strict=True):
        s, n = max(0.0, s + value - 20.0 - 1.0), n + 1
        out.append((key[0], ts, s, n))
    state.update((s, n))
    yield pd.DataFrame(out, columns=["symbol", "ts", "cusum", "n"])


def cusum_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state over the event stream."""
    e = events_stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    out = e.groupBy("symbol").applyInPandasWithState(cusum_update, "symbol string, ts timestamp, cusum double, n long", "s double, n long", "append", "NoTimeout")
    return to_files(out, "cusum").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("cusum", 6).alias("cusum"), "n")
