"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each shard posts its vectors in one inverted file for each
pivot, with the pivot's place in the vector's order. A query walks the files of its own nearest pivots, which adds up
the footrule distance of the two orders (a pivot outside an order stands just behind its end); the vectors of the
smallest distance are ranked again by the measure itself.

Shards stay where they are: a shard's vectors come first in its partition, and the queries stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.llm.arrow import bounded_batches
from starfold.llm.scratch import Scratch
from starfold.llm.search import usable

PIVOTS, PREFIX = 256, 96
SHARE, LEAST = 0.12, 1_000
SAMPLE_ROWS, SHARD_ROWS = 2_048, 131_072


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's ``prefix`` nearest pivots, nearest first; equal ones by number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors: the first, then always the one whose nearest chosen one is farthest, by angle."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near, chosen = np.full(len(units), -np.inf), []
    for _ in range(min(n, len(units))):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, units @ units[chosen[-1]])
        near[chosen[-1]] = np.inf
    return vectors[chosen]


class Index:
    """Inverted files of one shard, one for each pivot.

    As more than a third of the vectors stand in each file, a file is kept dense: the pivot's place in the order of each
    entry, one byte, and ``prefix`` where the entry's order doesn't hold it.
    """

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], pivots: np.ndarray, prefix: int) -> None:
        self.vectors, self.ids, self.pivots = vectors, ids, pivots
        self.first = np.array([i[0] for i in ids], np.int64)
        self.prefix = min(prefix, len(pivots), 255)
        self.files = np.full((len(pivots), len(vectors)), self.prefix, np.uint8)
        cells = np.empty(len(vectors), np.int64)
        for at in range(0, len(vectors), 4096):
            orders = nearest_pivots(vectors[at:at + 4096], pivots, self.prefix)
            self.files[orders, np.arange(at, at + len(orders))[:, None]] = np.arange(self.prefix, dtype=np.uint8)
            cells[at:at + 4096] = orders[:, 0]
        # An entry counts less, the more entries have the same nearest pivot beyond the average, so that a crowd of
        # near copies takes no places from others.
        self.weights = 1 / np.maximum(np.bincount(cells)[cells] * len(pivots) / len(cells), 1)

    def closest(self, order: np.ndarray, n: int) -> np.ndarray:
        """The entries whose order has the smallest footrule distance from ``order``, until their weights reach ``n``.

        Against two orders without a common pivot, a common one at places i and j lowers the distance by
        2 * (prefix - max(i, j)). Entries as far away as the last one are taken too.
        """
        if n >= len(self.vectors):
            return np.arange(len(self.vectors))
        later = self.files[order]
        np.maximum(later, np.arange(len(order), dtype=np.uint8)[:, None], out=later)
        near = self.prefix * len(order) - later.sum(axis=0, dtype=np.uint16).astype(np.int64)
        held = np.cumsum(np.bincount(near, self.weights)[::-1])
        border = len(held) - 1 - min(int(np.searchsorted(held, n)), len(held) - 1)
        return np.flatnonzero(near >= border)

    def search(self, own_id: int, query: np.ndarray, order: np.ndarray, candidates: int, k: int) -> list[tuple[float, int]]:
        """Score and id of the best ``k`` rows among the candidates, without one row of the query's own id and vector."""
        at = self.closest(order, candidates)
        scores = (self.vectors[at] * query).sum(axis=1)
        # The rows of the best k + 1 entries hold the best k, even if the query's own row is one of them.
        best = np.lexsort((self.first[at], -scores))[:k + 1]
        rows = []
        for i, score in zip(at[best].tolist(), scores[best].tolist()):
            ids = self.ids[i]
            if own_id in ids and np.array_equal(self.vectors[i], query):
                ids = list(ids)
                ids.remove(own_id)
            rows += [(-score, j) for j in ids]
        rows.sort()
        return [(-score, j) for score, j in rows[:k]]


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.asarray(lists.value_lengths())
    found = np.zeros((len(sizes), width))
    found[np.repeat(np.arange(len(sizes)), sizes),
          np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return found


def nearest(vectors: DataFrame, queries: Column, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
            pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST,
            sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` nearest rows found for each query.

    Queries are the rows where ``queries`` holds; candidates are all rows but the query's own. Nearness is the inner
    product in double precision; ties go to the smaller id. The index is fitted on ``sample_rows`` distinct vectors, those
    of the smallest hash, of which ``pivots`` that lie far from each other become pivots; it holds every row. ``share`` of
    the distinct vectors, ``least`` at least, are ranked again, more where near copies crowd.

    Equal vectors are one entry of the index, with their ``k + 1`` smallest ids, which is all that any query can return
    of them; so copies take no places from other candidates, however many there are. A repeated row is a candidate, and
    a query, as often as it occurs. Vectors that are null, all zero or hold a null, infinite or undefined component take
    no part, nor do rows with a null id. Where vectors differ in length, missing components count as zero. An empty
    table, or one without queries, gives an empty result; fewer than ``k`` candidates give fewer rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "permutation")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"),
                          queries.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.filter(F.exists("vector", lambda x: x != 0)).withColumn("vector", F.col("vector").cast("array<double>"))
    # Ids of equal vectors are cut to k + 1 before and after the shuffle, so no group of copies meets in a task.
    number = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = rows.select("id", "vector", number.alias("n")).filter(F.col("n") <= k + 1)
    entries = entries.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = scratch.write(entries.withColumn("hash", F.xxhash64("vector")), "entries")
    asked = rows.filter("asks").groupBy("id", "vector").agg(F.count(F.lit(1)).alias("times"))
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    sample = entries.orderBy("hash", "vector").limit(sample_rows).select("vector").toArrow()["vector"].combine_chunks()
    width, chosen = size["width"], spread(_matrix(sample, size["width"]), pivots)
    shards = max(math.ceil(size["n"] / shard_rows), min(spark.sparkContext.defaultParallelism, 64), 1)
    candidates = math.ceil(max(share * size["n"], least) / shards)

    columns = ["shard", "is_query", "hash", "vector", "ids", "id", "times"]
    held = entries.select(F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("is_query"), "hash",
                          "vector", "ids", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("times"))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_query"),
                        F.xxhash64("vector").alias("hash"), "vector", F.lit(None).cast("array<long>").alias("ids"), "id",
                        "times")
    dealt = held.select(*columns).unionByName(sent.select(*columns)).repartition(4 * shards, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, parts = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for start, stop in zip(cuts, cuts[1:]):
                piece = batch.slice(start, stop - start)
                own, is_query = divmod(int(kinds[start]), 2)
                if own != shard:
                    shard, index, parts = own, None, []
                if not is_query:
                    parts.append((_matrix(piece.column(3), width), piece.column(4).to_pylist()))
                    continue
                if parts:
                    index = Index(np.concatenate([m for m, _ in parts]), [i for _, ids in parts for i in ids], chosen, prefix)
                    parts = []
                if index is None:
                    continue  # no vector fell into this shard
                asks = _matrix(piece.column(3), width)
                orders = nearest_pivots(asks, chosen, index.prefix)
                found = [index.search(i, q, o, candidates, k) for i, q, o in zip(piece.column(5).to_pylist(), asks, orders)]
                which = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_pydict({
                    "query_id": piece.column(5).take(pa.array(which)), "hash": piece.column(2).take(pa.array(which)),
                    "times": piece.column(6).take(pa.array(which)),
                    "vec_id": pa.array([j for f in found for _, j in f], pa.int64()),
                    "score": pa.array([s for f in found for s, _ in f], pa.float64())})

    found = dealt.sortWithinPartitions("shard", "is_query").mapInArrow(
        run, "query_id long, hash long, times long, vec_id long, score double")
    order = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return ranked.select("query_id", "rank", "vec_id", "score")
