"""Connected components over a table of links. Nothing is gathered on the driver.

Tasks first contract the links they hold, CHUNK at a time, to one star a component of the chunk. Where one chunk held all links, these
stars are the result; else alternating large and small stars join those of the chunks, and again one chunk ends it once all links fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: Links that a task holds at once: 16 MB, and about 100 MB while they are contracted.
CHUNK = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) for each other node of a component of the links."""
    nodes, places = np.unique(np.r_[u, v], return_inverse=True)
    one, two = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[one], root[two]
        apart = a != b
        if not apart.any():
            break
        one, two = one[apart], two[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def star(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = contracted(*(np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        if held and n + batch.num_rows > CHUNK:
            yield star(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield star(held)


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """Stars of links that are written; tasks are merged until they hold about CHUNK links."""
    return edges.coalesce(math.ceil(count / CHUNK)).mapInArrow(_contract, "u long, v long")


def _least(links: DataFrame, both: bool) -> DataFrame:
    """Each link as (node, near), with the least near of the node; both: each link counts from either end."""
    one = links.select(F.col("v").alias("node"), F.col("u").alias("near"))
    if both:
        one = one.unionByName(links.select(F.col("u").alias("node"), F.col("v").alias("near")))
    # A node with very many links is one row here after partial sums, and its links stay spread by the skew join.
    least = one.groupBy("node").agg(F.min("near").alias("least"))
    return one.join(least, "node").withColumn("least", F.least("least", "node"))


def roots(spark: SparkSession, links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node with a link; root: the least node reachable. links: (u, v) of longs, any order; loops and nulls are left out.

    rows: where known, a count that the links are in line with, for the files of the checkpoint.
    """
    common.prepare(spark)
    edges = links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = edges.checkpoint() if rows is None else common.cut(edges, rows)
    before, count = None, edges.count()
    if count > CHUNK:
        edges = _contracted(edges, count).distinct().checkpoint()
    while True:
        mark = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == before or not mark[0]:
            break
        if mark[0] <= CHUNK:
            edges = _contracted(edges, mark[0]).checkpoint()
            break
        before = tuple(mark)
        large = _least(edges, True).where("near > node").select(F.col("least").alias("u"), F.col("near").alias("v"))
        large = large.where("u <> v").distinct()
        spread = _least(large, False)
        small = spread.select(F.col("least").alias("u"), F.col("near").alias("v")).unionByName(spread.select(F.col("least").alias("u"), F.col("node").alias("v")))
        edges = small.where("u <> v").distinct().checkpoint()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
