"""Connected components of an edge list, without ever gathering an unbounded graph.

Rounds of alternating star operations shrink the forest; each round is two aggregations with
map-side combination and two equality joins. Once a count proves that few enough edges are
left, one task with a union-find over that bounded list finishes. Both ways give the same
labels: the smallest node of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import drop, join_on, save

#: So many edges (16 bytes each) may be finished by one task.
LOCAL_EDGES = 2_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:  # every pass takes the least label over the edges, then jumps pointers
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _contract(batches):
    """Replace what one task holds of the edges by stars around each piece's smallest node."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if held:
        node, root = union_find(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        away = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(root[away])], names=["node", "root"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step, on edges (node, root) with node > root.

    Nodes with a large share of the edges are joined apart from the others.
    """
    both = save(edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))), "stars-both")
    least = save(both.groupBy("node").agg(F.min("root").alias("m"), F.count("*").alias("n")), "stars-least")
    near = least.select("node", F.least("m", "node").alias("m"))
    large = join_on(both.where("root > node"), near, "node", least.select("node", "n")).select(F.col("root").alias("node"), F.col("m").alias("root"))
    large = save(large.where("node != root").distinct(), "stars-large")
    least = save(large.groupBy("node").agg(F.min("root").alias("m"), F.count("*").alias("n")), "stars-least")
    moved = join_on(large, least.select("node", "m"), "node", least.select("node", "n")).select(F.col("root").alias("node"), F.col("m").alias("root")).where("node != root")
    return moved.unionByName(least.select("node", F.col("m").alias("root"))).distinct()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node with an edge that is not its component's smallest node.

    ``edges`` has two long columns and is read more than once: give a saved frame. Loops and
    repeated edges are allowed; no edges, no rows.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    current, owned = pairs, None
    while True:
        if current.limit(local_edges + 1).count() <= local_edges:
            return current.repartition(1).mapInArrow(_contract, "node long, root long")
        after = save(_stars(current), "stars")
        same = owned is not None and after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty()
        if owned is not None:
            drop(owned)
        if same:
            return after
        current = owned = after
