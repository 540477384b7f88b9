"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from porelake.llm.common import discard, staged

#: Vertices that one task's local contraction holds before it hands on what it has.
LOCAL_VERTICES = 200_000


class Forest:
    """Union-find over hashable labels; the smallest label of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up.setdefault(a, a)
        self.up[b] = a
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's edges become stars around the smallest vertex of what is connected within the task."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        found = [(x, root) for x in list(forest.up) if (root := forest.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
        if len(forest.up) > LOCAL_VERTICES:
            yield stars()
            forest = Forest()
    yield stars()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return row.n, row.s or 0


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (vertex, root): root is the smallest vertex that a vertex is connected with.

    Vertices that are their own root have no row. Self-loops and repeated edges are allowed; no edges give no rows.
    Each round aggregates before it joins and writes both sides of a join first, so a hub's edges meet in a join of plain
    shuffles only, whose hot keys AQE splits.
    """
    edges = staged(edges.where("a != b").mapInArrow(_contract, "a long, b long").distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = staged(large)
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        old, edges = edges, staged(small)
        discard(old, lows, large, low)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
