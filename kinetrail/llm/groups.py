"""Connected components of edges between 64-bit nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import discard, stored

#: Nodes that a task's union-find holds; what it knows is then passed on and it starts anew.
HELD = 1_000_000
#: Edges of a task, about.
SHARE = 500_000


class Forest:
    """Union-find; a root is the smallest node of its tree."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        root = a
        while (b := up.get(root, root)) != root:
            root = b
        while a != root:
            up[a], a = root, up.get(a, a)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        """Each node but the roots, and its root."""
        nodes = list(self.up)
        return nodes, [self.find(a) for a in nodes]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, names = Forest(), ["a", "b"]
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.union(a, b)
        if len(forest.up) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest.edges()], names)
            forest = Forest()
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest.edges()], names)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect what edges connect: those of a task shrink to one for each node but the roots."""
    return edges.select("a", "b").mapInArrow(_contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node that edges lead to. No edges: no rows.

    Alternating star contraction: each round points a node's larger neighbours, then itself, to the smallest one, and
    each task's edges are contracted before they are written to the shared folder. The smallest neighbours of nodes with
    very many of them come by broadcast, at most 20,000 rows of two numbers, so no task gets all edges of a hub.
    """
    now = stored(contracted(edges), "edges")
    seen = None
    while True:
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            break
        seen, n = sign, sign[0]
        tasks, hub = max(8, n // SHARE), max(1000, n // 10_000)

        def point(rows: DataFrame, least: DataFrame) -> DataFrame:
            """Edges from b to the smallest neighbour of a."""
            if n <= hub:
                return rows.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            marked = rows.join(F.broadcast(least.filter(F.col("k") > hub).select("a", F.col("m").alias("h"))), "a", "left")
            light = marked.filter("h is null").drop("h").join(least.filter(F.col("k") <= hub), "a")
            return light.select(F.col("b").alias("a"), F.col("m").alias("b")).union(marked.filter("h is not null").select(F.col("b").alias("a"), F.col("h").alias("b")))

        two = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("k"))
        large = stored(contracted(point(two.filter("b > a"), least).filter("a <> b").coalesce(tasks)), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = point(large, low).filter("a <> b").union(low.select("a", F.col("m").alias("b")))
        old, now = now, stored(contracted(small.coalesce(tasks)), "edges")
        discard(old, large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
