"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize

#: Up to so many edges are joined in one task; more in rounds of stars. The labels are the same.
FEW_EDGES = 200_000


def _star(edges: DataFrame, near: str, far: str) -> DataFrame:
    """Each node sends its neighbours (those on its far side) to the least node it sees."""
    least = edges.groupBy(near).agg(F.min(far).alias("m")).withColumn("m", F.least("m", near))
    return edges.join(least, near)


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long) -> node, label: the least node of its component. Nodes without an edge, or with a null end, are left out.

    Hubs are joined, never gathered; AQE splits them. Each round is written to the shared folder.
    """

    def written(edges: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        return materialize(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum"))), seen.get

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task's union-find."""
        parts = list(batches)
        u, v = (np.concatenate([b.column(i).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = np.arange(len(nodes))
        for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "label"])

    edges, before = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if before["n"] <= FEW_EDGES:
        return edges.coalesce(1).mapInArrow(joined, "node long, label long")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges, now = written(small.distinct())
        if now == before:
            break
        before = now
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
