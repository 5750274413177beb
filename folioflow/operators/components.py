"""Connected components of many graphs at once, by contraction.

Tasks first contract the edges that they hold: a union-find over at most HELD edges at a time leaves a star for each part that hangs together,
so an edge table shrinks to a forest before anything is compared between tasks. Large-star and small-star steps then join what different tasks or
batches hold, until a checksum of the edges stays: the rounds grow with the logarithm of what is left, and have no cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.scratch import kept

#: Edges that a task contracts together.
HELD = 1 << 18


class Forest:
    """Union-find whose roots are least nodes."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, node):
        path = []
        while (up := self.parent.setdefault(node, node)) != node:
            path.append(node)
            node = up
        for p in path:
            self.parent[p] = node
        return node

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def contracted(edges: DataFrame) -> DataFrame:
    """Stars (graph, u, v), v < u, that link what the edges (graph, u, v) link, batch by batch of a task."""
    schema = edges.schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        forest, held, kind = Forest(), 0, None

        def out() -> Iterator[pa.RecordBatch]:
            stars = [(*node, forest.root(node)[-1]) for node in forest.parent if forest.root(node) != node]
            for i in range(0, len(stars), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*stars[i : i + (1 << 14)]), kind)], ["graph", "u", "v"])

        for batch in batches:
            kind = [c.type for c in batch.columns]
            for g, u, v in zip(*(c.to_pylist() for c in batch.columns)):
                forest.join((g, u), (g, v))
            held += batch.num_rows
            if held >= HELD:
                yield from out()
                forest, held = Forest(), 0
        if held:
            yield from out()

    return edges.mapInArrow(run, schema)


def _moved(edges: DataFrame, large: bool) -> DataFrame:
    """A step on stars (graph, u, v), v < u: all greater neighbours of a node, or all lesser ones, move to the least of its neighbourhood."""
    around = edges.unionByName(edges.select("graph", F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("graph", "u").agg(F.min("v").alias("w"))
    least = least.select("graph", "u", F.least("u", "w").alias("w"))
    linked = around.join(least, ["graph", "u"])
    moved = linked.where("v > u" if large else "v <> w").select("graph", F.col("v").alias("u"), F.col("w").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("graph", "u", F.col("w").alias("v")))
    return moved.where("u <> v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("graph", "u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Rows (*graph, node, root): for each node (u or v) of an edge of a graph the least node that it reaches there.

    Direction, repeats and loops don't matter, but a node with only a loop has no row; edges with a null end are left out; null graphs are graphs.
    """
    own = edges.where("u <> v").select(F.struct(*graph).alias("graph"), F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Edges of a graph meet in few tasks; those of a large one are dealt out by their nodes too.
    dealt = own.select(F.to_json("graph", {"ignoreNullFields": "false"}).alias("graph"), "u", "v").repartition("graph", F.pmod(F.xxhash64("v"), F.lit(4)))
    now = kept(contracted(dealt), "stars")
    before = _sum(now)
    while True:
        # What hangs together is united in tasks as well, so that each round does more than a step.
        after = kept(contracted(_moved(_moved(now, True), False)), "stars")
        said = _sum(after)
        now = after
        if said == before:
            break
        before = said
    stars = now.withColumn("graph", F.from_json("graph", own.schema["graph"].dataType)).select("graph.*", "u", "v")
    roots = stars.select(*graph, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(*graph, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
