"""Connected components by alternating large-star and small-star passes.

Edges stay in Spark throughout. Each pass takes the least neighbour of every vertex (an aggregate with map-side
combine) and joins it back to the edges; a vertex with very many neighbours is a skewed join key, which adaptive
execution splits. Lineage is cut with a checkpoint in the shared folder after each round. A graph of at most SMALL edges,
by count, is united in one task instead of by rounds of shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task unites, at most (16 bytes each).
SMALL = 16_384


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's union, by repeated hooking and jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if held:
        u, v = (np.concatenate(side) for side in zip(*held, strict=True))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[roots(len(ids), place[: len(u)], place[len(u) :])])], ["id", "component"])


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("w", "m").alias("m"))
    return edges.join(low, F.col("u") == F.col("w")).select("u", "v", "m")


def _star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()  # each u > v
    small = _least(large)
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (columns a, b); component: the least id reachable.

    Null ends and loops are dropped, repeated edges count once, no edges give no rows.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, mark = None, _mark(now)
    if mark[0] <= SMALL:
        return now.coalesce(1).mapInArrow(_united, "id long, component long")
    while mark != before and mark[0]:
        now = cut(_star(now))
        before, mark = mark, _mark(now)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (id, component) once these edges (a, b) are added: only present components are united, not their members."""
    if edges.isEmpty():
        return known
    root = lambda df, end: df.join(known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_")), end, "left").withColumn(end, F.coalesce(f"{end}_", end)).drop(f"{end}_")
    over = cut(components(root(root(edges.select("a", "b"), "a"), "b")))
    moved = known.join(over.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return moved.union(over.join(known.select("id"), "id", "left_anti").select("id", "component"))
