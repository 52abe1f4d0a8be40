"""Connected components over a table of edges, however large a component or a hub is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soundcheck.session import materialise

EDGES_AT_ONCE = 1_000_000


def forest(nodes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of ``nodes`` under ``pairs`` of indexes."""
    root = np.arange(len(nodes))
    if not len(pairs):
        return root
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (jump := new[new] != new).any():
            new = np.where(jump, new[new], new)
        if (new == root).all():
            return root
        root = new


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task become one edge from every node to the smallest node it is connected with there."""
    held, size = [], 0

    def flush():
        ends = np.concatenate(held)
        nodes, index = np.unique(ends, return_inverse=True)
        root = forest(nodes, index.reshape(-1, 2))
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        size += batch.num_rows
        if size >= EDGES_AT_ONCE:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def pointed(edges: DataFrame) -> bool:
    """Whether every u has one edge, to a v that has none: u > v, so each v is the smallest of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(
        edges.select("v", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 OR (a = 1 AND b = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node with an edge; ``edges`` has two long columns.

    Edges are contracted inside tasks, then large-star and small-star steps alternate until every node
    points at the smallest one. A hub's smallest neighbour is found by a combined aggregate, so no node is one task. Each
    step is written, so a lost executor repeats one step only. Nulls and loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = materialise(edges.mapInArrow(contract, "u long, v long").distinct(), "edges")
    while not pointed(now):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        now = materialise(small.distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
