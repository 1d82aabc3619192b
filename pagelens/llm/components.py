"""Connected components by alternating large and small stars, as DataFrame steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, materialize


_HELD = 1 << 21


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct nodes in order, the smallest node that each reaches by the links a-b)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while len(left := np.flatnonzero(root[x] != root[y])):
        x, y = x[left], y[left]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a partition with its smallest: as many links as nodes at most, which connect the same."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy())
        if len(a) > _HELD:
            a, b = merged(a, b)
    nodes, root = merged(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(root[nodes != root]), pa.array(nodes[nodes != root])], ["y", "x"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link to another one; component is the smallest node reachable.

    links: a, b bigint; order, repeats and self-links don't matter. Each partition first keeps a spanning part of its links.
    Each step is a grouped minimum, which combines before its shuffle, and a join back; edges are written to the shared
    folder after each round, of which there are about log(n).
    """
    edges = links.where("a != b").select("a", "b").mapInArrow(_spanning, "y bigint, x bigint").distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y").where("x != y").distinct()
        used, edges = edges, materialize(small, "edges")
        done_with(used)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).union(edges.select("y", "y").distinct())
        before = now
