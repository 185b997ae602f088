"""Connected components of a distributed edge list, by large-star and small-star rounds.

Every round writes its edges to the shared folder, so lineage stays short and a lost
executor costs one round. Before a round, each partition contracts its own edges with
union-find, at most about ``NODES`` nodes at a time, and equal edges become one. Minima by
node are combined before their shuffle and written, so both sides of the join with a
root's many edges are plain shuffles, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

EDGES = "a long, b long"
NODES = 1 << 18  # that a task holds in one forest


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, top)
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def edges() -> pa.RecordBatch:
        nodes = list(forest.parent)
        roots = np.fromiter(map(forest.root, nodes), np.int64, len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) >= NODES:
            yield edges()
            forest = Forest()
    yield edges()


def _round(edges: DataFrame) -> DataFrame:
    """Edges (node, smaller node) after one large-star and one small-star step."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "component-minima")
    large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return small.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Whether anything changed shows in the number of edges and the sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with an edge to another; root is the component's smallest node and isn't itself listed."""
    now = written(edges.where("a != b").select("a", "b").mapInArrow(_contract, EDGES).distinct(), "component-edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        now = written(_round(now).mapInArrow(_contract, EDGES).distinct(), "component-edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
