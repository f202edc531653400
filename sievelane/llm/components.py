"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Every step is a shuffle by node with partial aggregation; joins by node are left to adaptive skew
splitting, so a node with many edges is no task of its own. Nothing is gathered on the driver but a count
and a checksum. Each round is written to the shared folder, so a lost executor never costs more than the round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, trim


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph with edges (a, b): its nodes and the smallest node of each one's component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        for side in (x, y):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to a star for each of its components: a bounded buffer, contracted when full."""
    a, b, size = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        size += batch.num_rows
        if size > 2_000_000:
            nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
            off = nodes != roots
            a, b, size = [nodes[off]], [roots[off]], 0
            if off.sum() > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], names=["a", "b"])
                a, b = [], []
    if a:
        nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
        off = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(roots[off])], names=["a", "b"])
    del a, b
    trim()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) whole numbers, in any order and repeated, to (node, component): component is the smallest node reachable.

    Nodes without an edge to another node aren't listed; null ends are ignored.
    """
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    edges = materialise(edges.mapInArrow(_contract, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        new = materialise(small)
        release(edges)
        edges, before = new, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
