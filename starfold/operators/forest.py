"""Which relationships of each model stay active: the first path between any two tables.

Taking edges in declared order and dropping each one that closes a loop leaves the spanning forest with the smallest
sequence numbers. An edge that closes a loop among some of a model's edges closes one among all, so each task first drops
those in the pieces that it reads. A model that lies in one piece is done by that. What is left of larger ones grows
together in rounds of joins, for all models at once: each component takes its first edge to another component, and joined
components merge. Components at least halve in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starfold.session import materialize

PIECE = 200_000  # edges of one model that a task holds at once


def forest(pairs: DataFrame, piece: int = PIECE) -> DataFrame:
    """``pairs`` (model_id, a, b, seq), one row per pair of tables, with a column ``in_forest``.

    Pairs that share a sequence number are taken in order of their tables.
    """
    found = marked(pairs.select("model_id", "a", "b", "seq"), piece)
    return found.select("model_id", "a", "b", "seq", "in_forest")


def marked(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """``edges`` (model_id, a, b, seq and more) with ``first_seq``, the first number of their pair of tables, and ``in_forest``,
    whether the pair is in the forest. Both are null where an end is null or both are the same.

    All edges of a pair are in one piece, in order, so a piece knows the pair's first one without a grouping.
    """
    sizes = edges.groupBy(F.col("model_id").alias("of_model")).agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.filter(F.col("n") > piece), "forest-large")  # few, if any: its size is known
    # A large model is dealt to several tasks.
    share = F.coalesce(F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / piece)), F.lit(0))
    dealt = edges.join(large, edges["model_id"].eqNullSafe(large["of_model"]), "left").select(
        *edges.columns, share.alias("piece"), F.col("n").isNotNull().alias("is_part"))
    order = ["model_id", "piece", F.asc_nulls_last("seq"), "a", "b"]
    dealt = dealt.repartition("model_id", "piece").sortWithinPartitions(*order)
    kinds = edges.select("*", F.col("seq").alias("first_seq"), F.lit(None).cast("boolean").alias("in_forest"),
                         F.lit(None).cast("boolean").alias("is_part")).schema
    kept = materialize(dealt.mapInArrow(_without_loops(edges.columns), kinds), "forest-pieces")
    open_edges = kept.filter("is_part and in_forest")
    if open_edges.isEmpty():
        return kept.drop("is_part")
    decided = kept.filter("not (is_part and coalesce(in_forest, false))").drop("is_part")
    # A null model is one too: within a struct, nulls are equal in joins.
    model = F.struct("model_id").alias("model_id")
    rounds = _in_rounds(open_edges.select(model, "a", "b", F.col("first_seq").alias("seq")).distinct()).select(
        F.col("model_id.model_id").alias("of_model"), F.col("a").alias("of_a"), F.col("b").alias("of_b"), F.col("in_forest").alias("found"))
    joined = open_edges.join(rounds, F.col("model_id").eqNullSafe(F.col("of_model")) & (F.col("a") == F.col("of_a"))
                             & (F.col("b") == F.col("of_b")), "left").withColumn("in_forest", F.col("found"))
    return decided.unionByName(joined.select(decided.columns))


def _without_loops(columns: list[str]):
    """A function that marks, in the sorted edges that a task reads, those that close no loop in their piece, and their
    pair's first number."""
    at = {name: columns.index(name) for name in ("model_id", "seq", "a", "b")}
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: dict = {}
        pairs: dict = {}
        model = object()

        def find(table):
            while leader.get(table, table) != table:
                leader[table] = leader.get(leader[table], leader[table])
                table = leader[table]
            return table

        for batch in batches:
            models, pieces, numbers, left, right = (batch.column(i).to_pylist() for i in (at["model_id"], n, at["seq"], at["a"], at["b"]))
            first, kept = [], []
            for m, p, seq, a, b in zip(models, pieces, numbers, left, right):
                if (m, p) != model:
                    model, leader, pairs = (m, p), {}, {}
                if a is None or b is None or a == b:
                    known = None, None
                elif (known := pairs.get((a, b))) is None:
                    x, y = find(a), find(b)
                    known = pairs[a, b] = seq, x != y
                    if x != y:
                        leader[x] = y
                first.append(known[0])
                kept.append(known[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(first, batch.column(at["seq"]).type), pa.array(kept, pa.bool_()), batch.column(n + 1)],
                names=[*columns, "first_seq", "in_forest", "is_part"])

    return run


def _in_rounds(pairs: DataFrame) -> DataFrame:
    edge = F.struct("seq", F.col("a").alias("first"), F.col("b").alias("second"))
    pairs = materialize(pairs.select("model_id", "a", "b", edge.alias("edge")), "forest-pairs")
    edges, chosen = pairs, [pairs.select("model_id", "edge").limit(0)]
    while not edges.isEmpty():
        ends = edges.select("model_id", F.col("a").alias("part"), F.col("b").alias("other"), "edge").unionByName(
            edges.select("model_id", F.col("b").alias("part"), F.col("a").alias("other"), "edge"))
        smallest = materialize(
            ends.groupBy("model_id", "part").agg(F.min(F.struct("edge", "other")).alias("taken"))
            .select("model_id", "part", "taken.other", "taken.edge"), "forest-smallest")
        chosen.append(smallest.select("model_id", "edge"))
        roots = _roots(smallest.select("model_id", "part", F.col("other").alias("root")))
        edges = materialize(_relabel(_relabel(edges, roots, "a"), roots, "b").filter("a <> b"), "forest-edges")
    found = reduce(DataFrame.unionByName, chosen).distinct().withColumn("found", F.lit(True))
    return pairs.join(found, ["model_id", "edge"], "left").select(
        "model_id", "a", "b", F.col("edge.seq").alias("seq"), F.col("found").isNotNull().alias("in_forest"))


def _relabel(edges: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    names = roots.withColumnsRenamed({"part": end, "root": "new_root"})
    joined = edges.join(names, ["model_id", end], "left")
    return joined.withColumn(end, F.coalesce("new_root", end)).select("model_id", "a", "b", "edge")


def _roots(pointers: DataFrame) -> DataFrame:
    """Follow part -> root pointers to their end, doubling. Edges are in a total order, so the only cycles are pairs."""
    back = pointers.select("model_id", F.col("part").alias("root"), F.col("root").alias("back"))
    broken = pointers.join(back, ["model_id", "root"], "left").select(
        "model_id", "part",
        F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("root")), F.col("part"))
        .otherwise(F.col("root")).alias("root"))
    current = materialize(broken, "forest-roots")
    while True:
        above = current.select("model_id", F.col("part").alias("root"), F.col("root").alias("above"))
        step = materialize(
            current.join(above, ["model_id", "root"], "left").select(
                "model_id", "part", F.coalesce("above", "root").alias("root"),
                (F.coalesce("above", "root") != F.col("root")).alias("moved")), "forest-roots")
        current = step.drop("moved")
        if step.filter("moved").isEmpty():
            return current
