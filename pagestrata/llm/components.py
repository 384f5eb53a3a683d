"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

_EDGE = "u long, v long"
#: Edges up to which one task finds the components; it changes the plan, not the result.
ONE_TASK = 1_000_000
#: Edges of a node beyond which its neighbours are handled without gathering them; it changes the plan, not the result.
HOT_EDGES = 1_000_000


def labels(u: np.ndarray, v: np.ndarray, m: int) -> np.ndarray:
    """The least node of the component of each of m nodes, given the edges (u, v)."""
    root = np.arange(m)
    while True:
        a, b = root[u], root[v]
        on = a != b
        if not on.any():
            return root
        u, v, a, b = u[on], v[on], a[on], b[on]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least of its component, which connect what the given ones do."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = labels(at[: len(u)], at[len(u) :], len(nodes))
    on = root != np.arange(len(nodes))
    return nodes[on], nodes[root[on]]


def _stars(small: bool):
    """Streams rows sorted by (u, v): every other neighbour of u, and u itself for the small star, gets an edge to the least of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = least = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = K.column(batch, "u"), K.column(batch, "v")
            first = np.concatenate([[node is None or u[0] != node], u[1:] != u[:-1]])
            again = np.concatenate([[not first[0] and v[0] == last], (u[1:] == u[:-1]) & (v[1:] == v[:-1])])
            at = np.flatnonzero(first)
            m = v[at] if small else np.minimum(v[at], u[at])
            if not first[0]:
                at, m = np.concatenate([[0], at]), np.concatenate([[least], m])
            m = np.repeat(m, np.diff(np.concatenate([at, [len(u)]])))
            node, least, last = u[-1], m[-1], v[-1]
            if small:  # every v is below its u
                on = ~first & ~again
                a, b = np.concatenate([v[on], u[first]]), np.concatenate([m[on], m[first]])
            else:
                on = (v > u) & ~again
                a, b = v[on], m[on]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return run


def _star(e: DataFrame, small: bool, rows: int) -> DataFrame:
    def gathered(x: DataFrame) -> DataFrame:
        return x.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_stars(small), _EDGE)

    if rows <= HOT_EDGES:
        return gathered(e)
    hot = K.cut(e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")).where(F.col("n") > HOT_EDGES).select("u", "m"))
    many = hot.count()
    if not many:
        return gathered(e)
    hot = K.small(hot, many)
    near = e.join(hot, "u")
    if small:
        near = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(hot.select("u", F.col("m").alias("v")))
    else:
        near = near.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return gathered(e.join(hot.select("u"), "u", "left_anti")).unionByName(near)


def _whole(t: pa.Table) -> pa.RecordBatch:
    u, v = forest(K.column(t, "u"), K.column(t, "v"))
    least = np.unique(v)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, least])), pa.array(np.concatenate([v, least]))], names=["node", "comp"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (u, v), comp being the least node of its component.

    Each round keeps the edge count bounded and is checkpointed; self-loops and
    repeated edges are harmless; no edges give no rows.  The many neighbours of a node
    are never held at once.
    """
    e = K.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropDuplicates())
    rows, state = e.count(), None
    if rows <= ONE_TASK:
        return K.cut(K.map_partition(e.coalesce(1), _whole, "node long, comp long"))
    while rows:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, False, 2 * rows)
        e = K.cut(_star(large, True, 2 * rows).dropDuplicates())
        row = e.agg(F.count("*"), F.coalesce(F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))"), F.lit(0))).first()
        if state == tuple(row):
            break
        rows, state = row[0], tuple(row)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
