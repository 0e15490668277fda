"""Operator 5: near-duplicate vectors by an epsilon grid order join.

Vectors of one label link when their cosine in double precision reaches the threshold t;
on unit vectors that is a distance of at most eps = sqrt(2 - 2t). Equal vectors of one label are one
class, so copies cost one row. Classes are projected on the leading principal directions
(orthonormal, so distances can only shrink), get grid cells of side eps there, and are
sorted by cells: the epsilon grid order. The order is cut into blocks. All blocks of a dense group meet, so where
many small partitions leave many small blocks the order is numbered over all partitions and cut by these numbers
instead. Two blocks meet only
if they share a label and a cell (with its neighbours) in the first ``KEYED`` directions, and
if the boxes of their projections are at most eps apart. So a first cell that holds many blocks is cut by the next directions. A pair of blocks is joined by halving
its sequence intervals; interval pairs whose boxes are further apart than eps are skipped,
small ones are compared in full.

A block pair returns counts and a spanning forest of its links, never the pairs themselves.

Defined results: a vector that is null, empty, zero, or holds null or non-finite numbers, or whose
label is null, links with nothing; labels of any type are compared as they are (by their text, with one zero); vectors of different lengths do not link; a component
whose ids are all null has a null id; rows that repeat an id are vectors of their own; an
empty table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.components import components

DIRECTIONS, KEYED = 6, 2
BLOCK_ROWS, LEAF_ROWS = 1024, 128
_BLOCK = "label string, dim int, cells array<array<int>>, low array<double>, high array<double>, nodes binary, sizes binary, vectors binary"


def _unit(vectors) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else the squares of very small or large numbers are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrices(batch, column: int):
    """(dim, row numbers, unit vectors) of an Arrow list column without nulls."""
    values = batch.column(column)
    flat, offsets = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    lens = np.diff(offsets)
    for dim in np.unique(lens):
        rows = np.flatnonzero(lens == dim)
        yield int(dim), rows, _unit(flat[offsets[rows][:, None] + np.arange(dim)])


def _directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions per vector length; dim x dim sums reach the driver, not rows."""

    def add(batches):
        import pyarrow as pa

        sums: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch, 0):
                own = sums.setdefault(dim, [0, np.zeros(dim), np.zeros((dim, dim))])
                own[0] += len(x)
                own[1] += x.sum(axis=0)
                own[2] += x.T @ x
        for dim, (n, one, two) in sums.items():
            flat = np.concatenate([[n], one, two.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["dim", "at", "value"])

    found: dict[int, np.ndarray] = {}
    sums = classes.select("vector").mapInArrow(add, "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value"))
    for row in sums.coalesce(8).toLocalIterator():  # a job for each partition
        dim = row["dim"]
        found.setdefault(dim, np.zeros(1 + dim + dim * dim))[row["at"]] = row["value"]
    out = {}
    for dim, flat in found.items():
        mean = flat[1 : 1 + dim] / flat[0]
        cov = flat[1 + dim :].reshape(dim, dim) / flat[0] - np.outer(mean, mean)
        out[dim] = np.linalg.eigh(cov)[1][:, ::-1][:, :DIRECTIONS].copy()
    return out


def _gap(low_a, high_a, low_b, high_b) -> float:
    """Distance of two boxes."""
    return math.sqrt((np.maximum(0, np.maximum(low_b - high_a, low_a - high_b)) ** 2).sum())


def _interval_join(a, b, same: bool, eps: float, least: float):
    """Links between two sequences (unit vectors, projections): yields (rows of a, rows of b) of linked pairs."""
    todo = [(0, len(a[0]), 0, len(b[0]))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k + m < i + j or i == j or k == m:
            continue  # within one block the mirrored interval pair has been or will be seen
        pa, pb = a[1][i:j], b[1][k:m]
        if _gap(pa.min(axis=0), pa.max(axis=0), pb.min(axis=0), pb.max(axis=0)) > eps:
            continue
        if j - i <= LEAF_ROWS and m - k <= LEAF_ROWS:
            x, y = np.nonzero(a[0][i:j] @ b[0][k:m].T >= least)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y
        elif same and (i, j) == (k, m):
            h = (i + j) // 2
            todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def _forest(n: int, pairs) -> np.ndarray:
    """Smallest row of each row's component under the linked pairs."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    vector = F.col(vector_col).cast("array<double>")
    label = F.col(label_col) + F.lit(0.0) if rows.schema[label_col].dataType.typeName() in ("float", "double") else F.col(label_col)  # one zero
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    valid = rows.where(good)
    classes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    classes = scratch.saved(classes.withColumn("node", F.monotonically_increasing_id()), "op5-classes")
    directions = _directions(classes)

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            places = [None] * batch.num_rows
            cells = [None] * batch.num_rows
            for dim, at, x in _matrices(batch, 1):
                p = x @ directions[dim]
                for r, own, cell in zip(at.tolist(), p.tolist(), np.floor(p / eps).astype(np.int32).tolist(), strict=True):
                    places[r], cells[r] = own, cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32()))], ["label", "vector", "size", "node", "place", "cells"])

    gridded = classes.select("label", "vector", "size", "node").mapInArrow(project, "label string, vector array<double>, size long, node long, place array<double>, cells array<int>")
    order = ["label", F.size("vector"), "cells", "node"]

    def block(batches):
        import pyarrow as pa

        held: list[dict] = []

        def flush():
            nonlocal held
            x = np.array([r["place"] for r in held])
            cells = np.array([r["cells"][:KEYED] for r in held])
            row = [held[0]["label"], len(held[0]["vector"]), np.stack([cells.min(axis=0), cells.max(axis=0)], axis=1).tolist(), x.min(axis=0).tolist(), x.max(axis=0).tolist()]
            row += [np.array([r["node"] for r in held], "<i8").tobytes(), np.array([r["size"] for r in held], "<i8").tobytes(), np.array([r["vector"] for r in held], "<f8").tobytes()]
            kinds = [pa.string(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.float64()), pa.list_(pa.float64())] + [pa.binary()] * 3
            held = []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= BLOCK_ROWS or r["chunk"] != held[0]["chunk"] or r["label"] != held[0]["label"] or len(r["vector"]) != len(held[0]["vector"])):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    cut = lambda rows: scratch.save(rows.mapInArrow(block, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "op5-blocks")
    ordered = gridded.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks, small = cut(ordered.withColumn("chunk", F.lit(0)))
    made, n, labels = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("nodes") / 8), F.lit(0)), F.count_distinct("label", "dim")).first()
    if made > 2 * (n // BLOCK_ROWS + labels):
        ordered, temp = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), "op5-order")
        part = F.shiftright("at", 33).cast("int")  # as that function numbers rows
        firsts, before = [], 0
        for row in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row per partition
            firsts.append((row["part"], before - (row["part"] << 33)))
            before += row["n"]
        firsts = ordered.sparkSession.createDataFrame(firsts, "part int, first long")
        numbered = ordered.withColumn("part", part).join(F.broadcast(firsts), "part").withColumn("chunk", F.floor((F.col("at") + F.col("first")) / BLOCK_ROWS))
        blocks, _ = cut(numbered.drop("part", "first").repartition("chunk").sortWithinPartitions("chunk", "at"))
        scratch.drop(ordered.sparkSession, temp, small)

    meta = blocks.select("block", "label", "dim", "cells", "low", "high")
    # Vectors shorter than KEYED have fewer directions; vectors of one length have the same.
    keys = lambda around: F.expr(f"aggregate(cells, array(''), (found, c) -> flatten(transform(sequence(c[0] - {around}, c[1] + {around}), v -> transform(found, f -> concat(f, '/', v)))))")
    left = meta.withColumn("cell", F.explode(keys(1))).alias("x")
    right = meta.withColumn("cell", F.explode(keys(0))).alias("y")
    gaps = F.expr("aggregate(zip_with(zip_with(x.low, y.high, (l, h) -> l - h), zip_with(y.low, x.high, (l, h) -> l - h), (g, h) -> greatest(g, h, 0D) * greatest(g, h, 0D)), 0D, (s, v) -> s + v)")
    met = left.join(right, F.expr("x.label = y.label AND x.dim = y.dim AND x.cell = y.cell AND x.block <= y.block") & (gaps <= eps * eps))
    met = met.select(F.col("x.block").alias("xb"), F.col("y.block").alias("yb")).distinct()
    side = lambda c: blocks.select(F.col("block").alias(f"{c}b"), F.col("dim").alias(f"{c}d"), *(F.col(n).alias(f"{c}{n[0]}") for n in ("nodes", "sizes", "vectors")))
    tasks = met.join(side("x"), "xb").join(side("y").drop("yd"), "yb").select("xb", "yb", "xd", "xn", "xs", "xv", "yn", "ys", "yv")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                same, dim = row["xb"] == row["yb"], row["xd"]
                sides = []
                for c in "xy":
                    unit = _unit(np.frombuffer(row[f"{c}v"], "<f8").reshape(-1, dim))
                    sides.append((unit, unit @ directions[dim], np.frombuffer(row[f"{c}n"], "<i8"), np.frombuffer(row[f"{c}s"], "<i8")))
                (_, _, xn, xs), (_, _, yn, ys) = sides
                nodes = xn if same else np.concatenate([xn, yn])
                shift = 0 if same else len(xn)
                counts, linked = np.zeros(len(nodes), np.int64), []
                for x, y in _interval_join(sides[0], sides[1], same, eps, threshold):
                    np.add.at(counts, x, ys[y])
                    np.add.at(counts, y + shift, xs[x])
                    linked.append((x, y + shift))
                root = _forest(len(nodes), linked)
                there = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[there]), pa.array(counts[there]), pa.array(nodes[root[there]])], ["node", "links", "other"])

    found = scratch.saved(tasks.mapInArrow(compare, "node long, links long, other long"), "op5-links")
    roots = components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = valid.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(scratch.table(spark, sf_dir, "embeddings"))
