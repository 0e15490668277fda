"""Connected components of an edge table, by contraction.

In each turn every node hooks to its smallest neighbour, hooks are followed to their roots
by pointer doubling, and the edges are relabelled by root; loops and repeats go. All steps
are joins and map-side minima over tables in the shared folder, so no node's edges are
gathered anywhere and nothing reaches the driver but counts. A turn removes every node
that is not a local minimum; few turns are needed even for long chains. Once at most
``LOCAL_EDGES`` edges are left (16 bytes each, so a task holds them whatever the input),
one task finishes them by union-find.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgauge.llm import scratch


LOCAL_EDGES = 1_000_000


def _finished(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges, in one task."""

    def run(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
        while True:  # places are in order of names, so the smallest place is the smallest name
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["node", "root"])

    return scratch.saved(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "cc-finished")


def _doubled(parents: DataFrame) -> DataFrame:
    """Follow (node, root) pointers until all roots point to themselves. Nodes without a row are roots."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above").isNotNull() & (F.col("above") != F.col("root"))).alias("moved"))
        step = scratch.saved(step, "cc-step")
        moved = not step.where("moved").isEmpty()
        parents = step.drop("moved")
        if not moved:
            return parents


def _above(found: DataFrame, roots: DataFrame) -> DataFrame:
    up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Loops and null ends are ignored; an empty table gives no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = scratch.saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found = None
    while True:
        n = edges.count()
        if n <= LOCAL_EDGES:
            roots = _finished(edges)
            return roots if found is None else _above(found, roots).unionByName(roots.join(found.select("node"), "node", "left_anti"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        roots = _doubled(scratch.saved(hooks.select("node", F.least("node", "least").alias("root")), "cc-hooks"))
        if found is None:
            found = roots
        else:
            found = scratch.saved(_above(found, roots), "cc-found")
        to_a, to_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        ends = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        edges = scratch.saved(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
