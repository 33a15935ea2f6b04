"""Connected components of an edge table: contraction within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import materialise, ship

#: Nodes that a task holds while it contracts the edges at hand.
HELD_NODES = 300_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from every node to the smallest one that the edges at hand connect it with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = parent[above]
            x = above
        return x

    def emit() -> pa.RecordBatch:
        ends = [(x, root(x)) for x in list(parent)]
        ends = [(x, r) for x, r in ends if x != r]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*ends) if ends else ((), ()))], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            p, q = root(u), root(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
        if len(parent) > HELD_NODES:
            yield emit()
            parent.clear()
    if parent:
        yield emit()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join each node's neighbours to its smallest one. ``edges`` has ``u > v``."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` edges (whole numbers); the component is its smallest node.

    First every task joins what its own edges connect, a bounded number of nodes at a time; few edges are settled by
    that. Each round of the rest writes its edges to shared storage, so lineage stays short and a lost executor costs
    little. Null ends make no edge. Nodes without an edge to another, and the components' own smallest nodes, are not
    listed.
    """
    ship(edges.sparkSession)
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    current = materialise(ordered.mapInArrow(_contract, "u long, v long"), "components")
    while True:
        open_ = current.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low <> high").select("u")
        above = current.select(F.col("v").alias("u")).distinct().join(current, "u", "left_semi")
        if open_.unionByName(above).isEmpty():  # every node has one neighbour, and that one has none below it
            return current.distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))
        current = materialise(_star(_star(current, large=True), large=False), "components")
