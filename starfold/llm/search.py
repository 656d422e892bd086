"""Exact top-k search by MaxScore, in shards.

A query's terms are the dimensions in which it is not zero. A dimension's posting holds the rows of the shard whose value
there is not zero, and the bound of a term is the most that it can add to a score. In each run of rows a query splits
its terms by what it has found so far: those of the smallest bounds, which together cannot reach its k-th best score, are
not essential. Only postings of the essential ones are traversed; of the rows met there, those that could still enter the
best are probed in the others, largest bound first, while they stay competitive. Shards are merged at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.llm.scratch import Scratch

SHARD_ROWS, SHARD_CELLS = 65_536, 1 << 22
_FIRST_RUN, _RUN = 64, 4_096
_PROBED = 4  # terms probed before rows that are no longer competitive are left out
_EXACT = 2.0 ** 52  # sums of products below this are exact as doubles


class Shard:
    """Postings of one shard, in runs of rows in order of their ids, so ties need no look back."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, self.width = self.vectors.shape
        self.largest = float(np.abs(self.vectors).max(initial=0))
        cuts, size = [0], _FIRST_RUN
        while cuts[-1] < n:
            cuts.append(min(cuts[-1] + size, n))
            size = min(2 * size, _RUN)
        self.runs = list(zip(cuts, cuts[1:]))
        # What a value can be at most and at least in a run; a row that is not in a posting has zero there.
        self.high = [np.maximum(self.vectors[a:b].max(axis=0), 0) for a, b in self.runs]
        self.low = [np.minimum(self.vectors[a:b].min(axis=0), 0) for a, b in self.runs]
        self.postings = []
        for values in np.ascontiguousarray(self.vectors.T):
            rows = np.flatnonzero(values)
            if 2 * len(rows) >= n:  # most rows have a value, so the posting is the column itself
                self.postings.append((None, values, None))
            else:
                self.postings.append((rows, values[rows], np.searchsorted(rows, cuts)))

    def traverse(self, run: int, term: int, weight: int, scores: np.ndarray) -> None:
        """Add what the posting of ``term`` gives to the scores of a run's rows."""
        start, end = self.runs[run]
        rows, values, places = self.postings[term]
        if rows is None:
            scores += weight * values[start:end]
        else:
            at = slice(places[run], places[run + 1])
            scores[rows[at] - start] += weight * values[at]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best ``k`` rows, best first, smaller ids first among equal scores."""
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(self.width, 1) < _EXACT
        query = query.astype(np.float64 if exact else np.int64)
        terms = np.flatnonzero(query)
        weights = query[terms]
        best, best_ids = np.empty(0, query.dtype), np.empty(0, np.int64)
        for run, (start, end) in enumerate(self.runs):
            bounds = np.maximum(weights * self.high[run][terms], weights * self.low[run][terms])
            order = np.argsort(bounds, kind="stable")
            reach = np.concatenate([[0], np.cumsum(bounds[order])])  # of the first terms together
            # Below zero, rows that share no term with the query compete too.
            open_to_all = len(best) < k or best[-1] < 0
            threshold = None if len(best) < k else best[-1]
            spare = 0 if open_to_all else int(np.searchsorted(reach, threshold, side="right")) - 1
            scores = np.zeros(end - start, query.dtype)
            for i in order[spare:]:
                self.traverse(run, terms[i], weights[i], scores)
            if threshold is None:
                rows = np.arange(len(scores))
            else:
                rows = np.flatnonzero(scores + reach[spare] > threshold)
            scores = scores[rows]
            while spare and len(rows):
                probe = order[max(spare - _PROBED, 0):spare]
                scores = scores + self.vectors[start + rows[:, None], terms[probe]] @ weights[probe]
                spare -= len(probe)
                keep = scores + reach[spare] > threshold
                rows, scores = rows[keep], scores[keep]
            if len(rows):
                best, best_ids = np.concatenate([best, scores]), np.concatenate([best_ids, self.ids[start + rows]])
                first = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[first], best_ids[first]
        return best.astype(np.int64), best_ids


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.asarray(lists.value_lengths())
    found = np.zeros((len(sizes), width), np.int64)
    found[np.repeat(np.arange(len(sizes)), sizes),
          np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return found


def top_k(vectors: DataFrame, queries: Column, *, k: int = 5, id_column: str = "vec_id",
          vector_column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` best vectors of each query.

    Queries are the rows where ``queries`` holds, candidates all rows but the query's own. The score is the integer inner
    product of the quantised vectors; ties go to the smaller id. A task holds a shard of about ``shard_rows`` rows, fewer
    if they are wide; the queries stream past it, and it keeps ``k + 1`` rows of each, one for the query's own.

    Vectors that are null or hold a null, infinite or undefined component take no part, nor do rows with a null id. A
    repeated row is a candidate, and a query, as often as it occurs: its copies find each other. So do other rows of the
    query's id. Where vectors differ in length, missing components count as zero. An empty table, or one without
    queries, gives an empty result; fewer than ``k`` candidates give fewer rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("raw"),
                          queries.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("raw")))
    # Repeated rows become one before they meet, and a query's number is written, so that it stays the same.
    entries = rows.groupBy("id", quantised(F.col("raw")).alias("vector")).agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("asks").alias("times"))
    entries = Scratch(spark, "maxscore").write(entries.withColumn("number", F.monotonically_increasing_id()), "entries")
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    width = size["width"]
    shards = max(math.ceil(size["n"] / min(shard_rows, max(SHARD_CELLS // max(width, 1), 1))),
                 min(spark.sparkContext.defaultParallelism, 64), 1)

    columns = ["shard", "is_query", "id", "vector", "copies", "number"]
    held = entries.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int")).withColumn(
        "is_query", F.lit(0)).withColumn("copies", F.least("copies", F.lit(k + 1).cast("long")))
    sent = entries.filter("times > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn(
        "is_query", F.lit(1)).withColumn("copies", F.col("times"))
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
                ids, matrix = piece.column(2).to_numpy(), _matrix(piece.column(3), width)
                if not is_query:
                    copies = piece.column(4).to_numpy()
                    parts.append((np.repeat(matrix, copies, axis=0), np.repeat(ids, copies)))
                    continue
                if parts:
                    index, parts = Shard(np.concatenate([m for m, _ in parts]), np.concatenate([i for _, i in parts])), []
                if index is None:
                    continue  # no row fell into this shard
                found = [index.search(query, k + 1) for query in matrix]
                which = np.repeat(np.arange(len(found)), [len(ids) for _, ids in found])
                yield pa.RecordBatch.from_pydict({
                    "number": piece.column(5).take(pa.array(which)), "query_id": pa.array(ids[which]),
                    "times": piece.column(4).take(pa.array(which)), "own_score": pa.array((matrix * matrix).sum(axis=1)[which]),
                    "vec_id": pa.array(np.concatenate([ids for _, ids in found])),
                    "score": pa.array(np.concatenate([scores for scores, _ in found]))})

    found = dealt.sortWithinPartitions("shard", "is_query").mapInArrow(
        run, "number long, query_id long, times long, own_score long, vec_id long, score long")
    query = Window.partitionBy("number")
    placed = found.withColumn("place", F.row_number().over(query.orderBy(F.desc("score"), "vec_id")))
    # Rows of one id and score are alike in the result, so the first of them stands for the query's own.
    is_own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score"))
    placed = placed.filter(F.col("place") <= k + 1).withColumn("own", F.min(F.when(is_own, F.col("place"))).over(query))
    others = placed.filter(~F.col("place").eqNullSafe(F.col("own")))
    ranked = others.withColumn("rank", (F.col("place") - (F.col("place") > F.coalesce("own", F.lit(k + 1))).cast("int")))
    ranked = ranked.filter(F.col("rank") <= k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return ranked.select("query_id", "rank", "vec_id", "score")
