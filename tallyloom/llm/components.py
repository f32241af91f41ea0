"""Connected components of a thin edge table.

Edges are first brought down to spanning forests, FOREST_EDGES to a task (equal edges in one task at first), again and
again while that makes them fewer; what fits in one task is then done. What does not goes through label propagation with
pointer jumping: every round is two joins and one pre-aggregated minimum, its labels are written to the shared folder, so lineage stays short and lost
executors lose nothing, and rounds grow with the logarithm of the longest chain. Nothing is collected but one count a
round.

Defined cases: edges with a null end do not count; loops and repeated edges do no harm, and a node that only has a
loop is its own component; no edges give no nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import in_arrow, materialize

#: Edges that one task brings down to a forest (32 MB).
FOREST_EDGES = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node it reaches) of every node of the edges a-b."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges a-b: (node, the smallest node it reaches), for nodes that are not the smallest."""
    node, root = roots(a, b)
    return node[node != root], root[node != root]


def _in_tasks(edges: DataFrame, every: bool) -> DataFrame:
    """(u, v) by tasks: each node with its root, roots too if `every`, else only those that have no other edge (loops)."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, root = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            keep = node != root
            keep |= every | ~np.isin(node, root[keep])
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["u", "v"])

    return in_arrow(edges, run, "u long, v long")


def connected(edges: DataFrame, a: str = "a", b: str = "b", forest_edges: int = FOREST_EDGES) -> DataFrame:
    """(node, root): each node of an edge with the smallest node reachable."""
    one = materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null"))
    n, first = one.count(), True
    while n > forest_edges:
        tasks = -(-n // forest_edges)
        # first the same edges come together: slices find an edge again in as many tasks as there are
        one = materialize(_in_tasks(one.repartition(tasks, "u", "v") if first else one.repartition(tasks), False))
        before, n = n, one.count()
        if n > before // 2 and not first:
            break
        first = False
    if n <= forest_edges:
        return materialize(_in_tasks(one.coalesce(1), True)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return _propagated(one)


def _propagated(one: DataFrame) -> DataFrame:
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = materialize(one.select(ways.alias("e")).select("e.u", "e.v").distinct())
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("u"), "left").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        after = materialize(hooked.join(jump, "low", "left").select("node", F.least("low", "next").alias("root"), (F.least("low", "next") != F.col("root")).alias("moved")))
        labels = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            return labels
