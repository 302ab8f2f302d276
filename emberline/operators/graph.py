"""Connected components and order-dependent greedy grouping over edge tables.

Both work in rounds of joins over written tables that shrink, so a lost executor costs one round at most and only
counts come back to the driver. What is left is solved in a single task once it has TASK_EDGES edges or fewer, a bound
that is checked and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline import staging

#: Edges that one task takes, 16 MB of them.
TASK_EDGES = 1 << 20


def _whole(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    held = list(batches)
    return [np.concatenate([np.zeros(0, np.int64), *(b.column(n).to_numpy() for b in held)]) for n in names]


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of n nodes: roots are hooked to smaller ones, then paths are cut short."""
    up = np.arange(n)
    while len(a):
        x, y = up[a], up[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            far = up[up]
            if (far == up).all():
                break
            up = far
    return up


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _whole(batches, "a", "b")
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = nodes[smallest_labels(at[: len(a)], at[len(a) :], len(nodes))] if len(nodes) else nodes
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(label, pa.int64())], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns a and b. Returns node and label, the smallest node of its component, for nodes with edges.

    Contraction: each node joins the neighbour, or itself, that comes first in an order drawn anew each round; edges
    between the nodes that others joined are what is left, a part of them. Labels go back through the rounds.
    """
    ends = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    level, steps = staging.persisted(ends(edges), "edges"), []
    while level.count() > TASK_EDGES:
        both = level.unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(drawn("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", drawn("a"))["v"].alias("joins"))
        steps.append(staging.persisted(first, "joins"))
        one, other = (steps[-1].withColumnsRenamed({"node": c, "joins": f"to_{c}"}) for c in ("a", "b"))
        level = staging.persisted(ends(level.join(one, "a").join(other, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "edges")
    labels = staging.persisted(level.coalesce(1).mapInArrow(_solved, "node long, label long"), "labels")
    if not steps:
        return labels
    for step in reversed(steps):
        known = labels.select(F.col("node").alias("joins"), "label")
        labels = staging.persisted(step.join(known, "joins", "left").select("node", F.coalesce("label", "joins").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return staging.persisted(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")


def with_components(nodes: DataFrame, edges: DataFrame, key: str, out: str) -> DataFrame:
    """nodes with the column out: the smallest key of the component, the own key where there is no edge."""
    found = components(edges).select(F.col("node").alias(key), F.col("label").alias("_label"))
    return nodes.join(found, key, "left").withColumn(out, F.coalesce("_label", key)).drop("_label")


def _first_come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that are not covered when their turn comes, of edges a < b."""
    a, b = _whole(batches, "a", "b")
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    nodes = np.unique(np.concatenate([a, b]))
    at, first = np.searchsorted(nodes, b), np.searchsorted(a, nodes)
    last = np.searchsorted(a, nodes, "right")
    free = np.ones(len(nodes), bool)
    for k in range(len(nodes)):
        if free[k]:
            free[at[first[k] : last[k]]] = False
    yield pa.record_batch([pa.array(nodes[free], pa.int64())], ["node"])


def uncovered(edges: DataFrame) -> DataFrame:
    """edges: long columns a < b, numbers in the order of turns. Returns node: those that are taken when, in turn, each
    node that no taken one covers is taken and covers its neighbours. Nodes without edges are taken, and not listed.

    A round takes the nodes that are no larger end of an edge, and drops them with all that they cover.
    """
    left, taken = staging.persisted(edges.select("a", "b").filter("a < b").distinct(), "turns"), []
    while left.count() > TASK_EDGES:
        now = left.select(F.col("a").alias("node")).distinct().join(left.select(F.col("b").alias("node")), "node", "left_anti")
        taken.append(staging.persisted(now, "taken"))
        covered = staging.persisted(left.join(taken[-1], F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct(), "covered")
        gone = taken[-1].unionByName(covered)
        rest = left.join(gone, F.col("a") == F.col("node"), "left_anti").join(gone, F.col("b") == F.col("node"), "left_anti")
        # a node whose neighbours are all covered has no edge left and is taken too
        open_ = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct().join(gone, "node", "left_anti")
        left = staging.persisted(rest, "turns")
        alone = open_.join(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))), "node", "left_anti")
        taken.append(staging.persisted(alone, "taken"))
    out = staging.persisted(left.coalesce(1).mapInArrow(_first_come, "node long"), "taken")
    for t in taken:
        out = out.unionByName(t)
    return out


def first_covering(edges: DataFrame) -> DataFrame:
    """node and anchor of every covered node of uncovered(edges): the first taken neighbour before it."""
    pairs = edges.select("a", "b").filter("a < b")
    return pairs.join(uncovered(pairs).withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("anchor"))


def greedy_anchors(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """First come, first anchor: in key order, a node without anchor becomes one and takes its free neighbours.
    edges a < b of keys. Returns key and anchor."""
    found = first_covering(edges).select(F.col("node").alias(key), "anchor")
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("anchor", key).alias("anchor"))
