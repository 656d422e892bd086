"""Near-duplicates by ProbMinHash: weighted shingles, Poisson arrivals with early termination, banding, verification.

The similarity is the probability Jaccard of two documents' shingles, weighted by how often each occurs. A signature's
register holds the shingle that arrives there first, where each shingle is a Poisson process with its weight as
rate; two registers agree with exactly that probability. Documents that agree in a whole band are candidates; candidates
are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starfold.llm.arrow import bounded_batches, chunks, ragged
from starfold.llm.graph import components
from starfold.llm.hashing import RangeHash, mix
from starfold.llm.scratch import Scratch
from starfold.llm.words import WordSplitter, shingles

WORDS, SIMILARITY = 5, 0.8
REGISTERS, ROWS = 128, 5  # 25 bands of 5: a pair at 0.8 is missed by all of them once in 20,000
_BROADCAST_ROWS = 200_000
_SMALL, _BLOCK, _COLUMNS = 24, 512, 4096  # members of a bucket compared pair by pair; of a block; shingles at once
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def weigh(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts, in order of the documents."""
    codes, _ = pd.factorize(mix(found + mix(owner.astype(np.uint64) + _G2)))
    counts = np.bincount(codes).astype(np.float64)
    where = np.empty(len(counts), np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return found[where], owner[where], counts


def prob_min_hash(items: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Registers of ``n`` documents, ``m`` each (a power of two); 0 where a document has no items.

    In round k every live item makes its k-th arrival at a register drawn at random. Arrival times only grow, so an
    item ends when its time is past all registers of its document.
    """
    first = np.full(n * m, np.inf)
    held = np.zeros(n * m, np.uint64)
    time = np.zeros(len(items))
    latest = np.full(n, np.inf)
    seed = mix(items + _G1)
    while len(seed):
        seed = mix(seed + _G2)
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weights
        live = time < latest[owner]
        items, owner, weights, time, seed = items[live], owner[live], weights[live], time[live], seed[live]
        at = owner * m + (seed & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        held[at[won]] = items[won]
        documents = np.unique(owner) if len(owner) < n else np.arange(n)
        latest[documents] = first.reshape(n, m)[documents].max(axis=1)
        live = time < latest[owner]
        items, owner, weights, time, seed = items[live], owner[live], weights[live], time[live], seed[live]
    return held.reshape(n, m)


def _keys(items: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """128 bits that do not depend on the order of the shingles: equal for equal weighted sets."""
    count = weights.astype(np.uint64)
    parts = []
    for salt in (_G1, _G2):
        part = np.zeros(n, np.uint64)
        np.add.at(part, owner, mix(mix(items + salt) * count + salt))
        parts.append(mix(part))
    return np.stack(parts, axis=1)


def signatures(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``text_hash``, ``node`` (equal for documents of equal shingles), and ``bands``."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("text_hash"),
                       F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, range_hash = WordSplitter(), RangeHash()
        n_bands = REGISTERS // ROWS
        salts = mix(np.arange(1, n_bands + 1, dtype=np.uint64) * _G1)
        for batch in chunks(batches, "text"):
            n = batch.num_rows
            found, owner = shingles(split(batch.column(2)), WORDS, range_hash)
            items, owner, weights = weigh(found, owner)
            held = prob_min_hash(items, owner, weights, n)
            keys = _keys(items, owner, weights, n)
            some = np.bincount(owner, minlength=n) > 0
            # Without any word, texts are alike only where they are equal.
            raw = batch.column(1).to_numpy().astype(np.int64).view(np.uint64)
            keys[~some, 0], keys[~some, 1] = mix(raw[~some] + _G2), mix(raw[~some] + _G1)
            bands = np.zeros((n, n_bands), np.uint64) + salts
            for row in range(ROWS):
                bands = mix(bands * _G2 + held[:, row:n_bands * ROWS:ROWS])
            nodes = pa.array([k.tobytes() for k in keys.astype(">u8")], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "text_hash": batch.column(1), "node": nodes,
                "bands": ragged(bands[some].view(np.int64).ravel(), np.cumsum(some) * n_bands, pa.int64())})

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, node binary, bands array<long>")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets: elements (sorted) and weights. 1 for equal sets, 0 for sets that share nothing."""
    both, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    only_a, only_b = x.sum() - x[in_a].sum(), y.sum() - y[in_b].sum()
    xs, ys = x[in_a], y[in_b]
    order = np.argsort(ys / xs)
    xs, ys = xs[order], ys[order]
    # For element d: the sum over all d' of max(x'/x, y'/y). Up to d in this order x'/x is the larger, then y'/y.
    below, above = np.cumsum(xs), ys.sum() - np.cumsum(ys)
    return float((1 / ((only_a + below) / xs + (only_b + above) / ys)).sum())


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, range_hash = WordSplitter(), RangeHash()

        def weighted(texts):
            found, owner = shingles(split(texts), WORDS, range_hash)
            items, owner, weights = weigh(found, owner)
            order = np.lexsort((items, owner))
            items, owner, weights = items[order], owner[order], weights[order]
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            return [(items[s:e], weights[s:e]) for s, e in zip(edges, edges[1:])]

        for batch in chunks(batches, "text_a"):
            sides = zip(weighted(batch.column(2)), weighted(batch.column(3)))
            alike = [probability_jaccard(*a, *b) >= similarity for a, b in sides]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The text of one document of each wanted node. Reads ``docs`` again; only wanted texts are written."""
    places = nodes.join(wanted, "node", "left_semi").select("node", "id", "text_hash")
    if wanted.count() <= _BROADCAST_ROWS:  # else both sides are shuffled
        places = F.broadcast(places)
    rows = docs.select(F.col(id_column).alias("doc"), F.xxhash64(F.col(text_column)).alias("hash"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = rows.join(places, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")))
    return found.select("node", "text").dropDuplicates(["node"])


def _classified(docs: DataFrame, similarity: float, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``text_hash``, ``class_id``, and ``place`` of the class: whether its id is null, its id and hash."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "neardup")
    marked = scratch.write(signatures(docs, id_column, text_column), "signatures")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    nodes = scratch.write(
        marked.groupBy("node").agg(F.min(place).alias("place"), F.min("id").alias("least"), F.first("bands").alias("bands")),
        "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = scratch.write(members.join(buckets.select("bucket", "head"), "bucket"), "members")
    pairs = scratch.write(members.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
                          .distinct(), "pairs")
    wanted = members.select("node").distinct()
    texts = scratch.write(_texts(docs, nodes.select("node", "place.id", "place.text_hash"), wanted, id_column, text_column),
                          "texts")
    links = scratch.write(_verify(pairs, texts, similarity), "links")
    roots = components(links, scratch)
    mixed = scratch.write(_mixed(members, roots), "mixed")
    more = scratch.write(_verify(_across(mixed, pairs), texts, similarity)
                         .unionByName(_in_blocks(mixed, texts, similarity)), "links")
    if not more.isEmpty():
        # The groups so far stand for the links that made them.
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)
    scratch.drop(members, pairs, texts, links, mixed, more)
    classes = nodes.select("node", "least", "place").join(roots, "node", "left").select(
        "node", "least", "place", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"), F.min("place").alias("place"))
    classes = classes.select("node", "root").join(least, "root").select("node", "class_id", "place")
    return marked.select("id", "text_hash", "node").join(classes, "node")


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``class_id``, the smallest id of its group of near-duplicates.

    Groups are the connected parts of the graph of all verified candidate pairs. Documents of equal shingles are one
    node. In each bucket all nodes are compared with the smallest; then, where members of a bucket are still in
    different groups, members of different groups are compared, in large buckets by matrix products over blocks. So no
    comparison is left out that could join two groups, and a bucket of copies costs as many as it has members.

    Texts without words, null and empty ones among them, are alike where they are equal. Null ids stay null and do
    not become a class id; a group of only null ids has a null class. Repeated rows come back repeated. An empty
    table gives an empty result; other columns are left out.
    """
    found = _classified(docs, similarity, id_column, text_column)
    return found.select(F.col("id").alias(id_column), "class_id")


def first_of_each(docs: DataFrame, *, similarity: float = SIMILARITY, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, null last. All columns stay.

    Of rows that share id and text, one stays too.
    """
    scratch = Scratch(docs.sparkSession, "neardup-rows")
    found = _classified(docs, similarity, id_column, text_column)
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    rows = scratch.write(found.groupBy("id", "text_hash", (own == F.col("place")).alias("is_first")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"), "is_first", "n"),
        "rows")
    others, repeated = rows.filter(~F.coalesce("is_first", F.lit(False))), rows.filter("is_first and n > 1")
    if others.count() <= _BROADCAST_ROWS:  # else both sides are shuffled
        others = F.broadcast(others)
    match = F.col(id_column).eqNullSafe(F.col("of_id")) & (F.xxhash64(F.col(text_column)) == F.col("of_hash"))
    kept = docs.join(others, match, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, match, "left_semi").dropDuplicates([id_column, text_column])
    return kept.join(repeated, match, "left_anti").unionByName(once)


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that still hold several groups: the members' groups, the bucket's size and largest group."""
    placed = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("groups"),
                                        F.sum("n").alias("size"))
    mixed = mixed.filter("groups > 1").select("bucket", F.col("top.root").alias("top"), "size")
    return placed.join(mixed, "bucket")


def _across(mixed: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of a small bucket that are in different groups and not compared yet: at most ``_SMALL`` for a member."""
    small = mixed.filter(F.col("size") <= _SMALL)
    few = small.filter("root <> top").select("bucket", F.col("node").alias("x"), F.col("root").alias("x_root"))
    met = few.join(small, "bucket").filter("x_root <> root").select(
        F.greatest("x", "node").alias("a"), F.least("x", "node").alias("b")).distinct()
    return met.join(done, ["a", "b"], "left_anti")


def _in_blocks(mixed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join groups of a large bucket.

    The members are dealt to blocks, and every pair of blocks is compared by matrix products. Of the links found, only
    those that join two groups within the pair of blocks are returned, so results grow with the members, not with
    the pairs.
    """
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = mixed.filter(F.col("size") > _SMALL).withColumn("own", own).withColumn("blocks", blocks)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(texts, "node").select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("is_left"), (F.col("own") >= F.col("other")).alias("is_right"),
        "node", "root", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)
        items, owner, weights = weigh(*shingles(WordSplitter()(texts), WORDS, RangeHash()))
        roots, _ = pd.factorize(np.array(table["root"].to_pylist(), object))
        left = np.flatnonzero(table["is_left"].to_numpy())
        right = np.flatnonzero(table["is_right"].to_numpy())
        found = _links(items, owner, weights, roots, left, right, similarity)
        nodes = table["node"].to_pylist()
        return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.binary()),
                         "b": pa.array([nodes[y] for _, y in found], pa.binary())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def _links(items, owner, weights, roots, left, right, similarity) -> list[tuple[int, int]]:
    n = len(roots)
    total = np.bincount(owner, weights, n)
    sizes = np.bincount(owner, minlength=n)
    codes, distinct = pd.factorize(items)
    # Only shingles of several documents can be shared.
    frequent = np.bincount(codes, minlength=len(distinct)) > 1
    column = np.cumsum(frequent) - 1
    shared = np.zeros((len(left), len(right)), np.float32)
    bound_l, bound_r = shared.copy(), shared.copy()
    plain = np.bincount(owner, weights != 1, n) == 0
    keep = frequent[codes]
    o, c, w = owner[keep], column[codes[keep]], (weights / total[owner])[keep]
    order = np.argsort(c, kind="stable")
    o, c, w = o[order], c[order], w[order].astype(np.float32)
    for at in range(0, int(frequent.sum()), _COLUMNS):
        s, e = np.searchsorted(c, [at, at + _COLUMNS])
        present = np.zeros((n, _COLUMNS), np.float32)
        present[o[s:e], c[s:e] - at] = 1
        shared += present[left] @ present[right].T
        if not plain.all():
            share = np.zeros((n, _COLUMNS), np.float32)
            share[o[s:e], c[s:e] - at] = w[s:e]
            bound_l += share[left] @ present[right].T
            bound_r += present[left] @ share[right].T
    exact = shared / np.maximum(sizes[left][:, None] + sizes[right][None, :] - shared, 1)
    both_plain = plain[left][:, None] & plain[right][None, :]
    # A pair's similarity is at most the share of either document's weight that lies on shared shingles.
    likely = np.where(both_plain, exact >= similarity - 1e-6, np.minimum(bound_l, bound_r) >= similarity - 1e-4)
    likely &= roots[left][:, None] != roots[right][None, :]
    edges = np.searchsorted(owner, np.arange(n + 1))
    leader = list(range(n))

    def find(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    found = []
    for x, y in zip(*(ids[at] for ids, at in zip((left, right), np.nonzero(likely)))):
        x, y = int(x), int(y)
        one, two = find(int(roots[x])), find(int(roots[y]))
        if one == two:
            continue
        if not (plain[x] and plain[y]):
            sides = []
            for d in (x, y):
                part = np.argsort(items[edges[d]:edges[d + 1]]) + edges[d]
                sides += [items[part], weights[part]]
            if probability_jaccard(*sides) < similarity:
                continue
        leader[one] = two
        found.append((x, y))
    return found
