"""Connected components: each node learns the smallest node that it can reach.

A graph that fits in one piece is followed within one task. Larger ones take rounds of joins, whose many small stages cost
the driver memory and time whatever the size of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starfold.llm.scratch import Scratch

PIECE = 200_000  # edges that a task holds at once


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges that the task reads, each member with the smallest."""
    found = list(batches)
    if not sum(batch.num_rows for batch in found):
        return
    edges = pa.Table.from_batches(found)
    ends = np.array(edges.column(0).to_pylist() + edges.column(1).to_pylist(), object)
    codes, nodes = pd.factorize(ends, sort=True)
    leader = list(range(len(nodes)))

    def find(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for x, y in codes.reshape(2, -1).T.tolist():
        one, two = find(x), find(y)
        leader[max(one, two)] = min(one, two)
    roots = [find(x) for x in range(len(nodes))]
    members = [x for x, root in enumerate(roots) if x != root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes[x], edges.schema.types[0]) for x in (members, [roots[m] for m in members])],
                                     names=["node", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. In ``edges``, b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = edges.join(least, "a")
    moved = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, piece: int = PIECE) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node of ``edges`` (a, b) but the roots.

    Up to ``piece`` different edges are one task's work. For more, alternating large and small stars needs about log(n) rounds. Groups are pre-aggregated to a minimum before they are
    joined back, so a node with very many edges needs no single task. Ends when a round changes nothing.
    """
    current = scratch.write(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if current.count() <= piece:
        kind = current.schema["a"].dataType.simpleString()
        stars = scratch.write(current.repartition(1).mapInArrow(_stars, f"node {kind}, root {kind}"), "stars")
        scratch.drop(current)
        return stars
    while True:
        following = scratch.write(_small_star(_large_star(current)), "edges")
        # Stars only: no node is both a member and a centre, and no member has two centres.
        centres = following.select(F.col("b").alias("a")).distinct()
        settled = following.join(centres, "a", "left_semi").isEmpty() and \
            following.groupBy("a").count().filter("count > 1").isEmpty()
        scratch.drop(current)
        current = following
        if settled:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
