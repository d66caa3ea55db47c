"""What the operators of this subpackage share: the worker path, words, Arrow helpers and durable cuts of lineage."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Texts are long: unless the session says otherwise, an Arrow batch to or from a worker has so many bytes (Spark's default is 64 MB).
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: A bitmap of hashes has so many words of 64 bits at most, whatever is marked in it, so it may be broadcast.
WORD_BITS = 18
#: So many rows of its input are enough for a task that writes a checkpoint.
ROWS_A_FILE = 1200


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver found it, and see to a checkpoint folder.

    The cluster names the folder in spark.checkpoint.dir. Only where it is unset and Spark runs in this process, as in local tests, a
    temporary one is made; elsewhere executors would not share it, so that is an error.
    """
    spark.conf.set(BATCH_BYTES, spark.conf.get(BATCH_BYTES, BATCH))
    root = str(Path(__file__).resolve().parents[2])
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark


def cut(df: DataFrame, rows: int) -> DataFrame:
    """A checkpoint of a table in line with so many rows, in no more files than they need.

    To set the mode of a file of the local file system each task starts a process, which for a moment counts as large as the executor.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_FILE))
    return (df.coalesce(parts) if parts < int(spark.conf.get("spark.sql.shuffle.partitions")) else df).checkpoint()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder; nothing is created yet."""
    return f"{prepare(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _place(hashed: Column) -> tuple[Column, Column]:
    """The word of a hash (long) and its bit there."""
    bit = F.shiftrightunsigned(hashed, WORD_BITS).bitwiseAND(F.lit(63)).cast("int")
    return hashed.bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bitmap(hashes: DataFrame) -> DataFrame:
    """(_word, _bits): the bits of the hashes in the only column, as a table of at most 2**WORD_BITS rows."""
    word, bit = _place(F.col(hashes.columns[0]))
    return hashes.select(word.alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def marked(rows: DataFrame, hashed: Column, bits: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose bit is set: all those with a hash of the bitmap, and a few more; left_anti: the others. Nothing is dealt out.

    A join that drops the few more is still needed; the fuller the bitmap, the less it spares that join, and no row is lost.
    """
    word, bit = _place(hashed)
    return rows.join(F.broadcast(bits), (word == bits["_word"]) & (bit.bitwiseAND(bits["_bits"]) != 0), how)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\t\\n\\v\\f\\r, A-Z lower-cased; bytes.split() cuts at just these."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def word_count(text: str | None) -> int:
    return len(text.encode("utf-8", "surrogatepass").split()) if text else 0


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a string column as Python values, so that no more than a few hundred texts are held as str at once."""
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
