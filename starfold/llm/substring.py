"""Repeated passages by collinear chaining of shared k-mers.

Seeds are k-mers of words, picked by winnowing. Each occurrence of a seed is joined with one occurrence, that in the
document of the smallest key, so a seed of very many documents gives as many matches as it has occurrences. The matches
of two documents are chained in order, with gap costs, through a Fenwick tree; chains are aligned word by word over the
texts, which finds passages that were changed here and there, and their exact ends; a chain that runs over several
passages is split where they end.

A passage whose seeds all have their first places elsewhere, as it is made of lines that other documents hold, would not
be found so. A second pass takes all runs of ``min_words`` words from what is shared but not yet listed: the smallest
document that has such a run holds a passage.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starfold.llm.arrow import bounded_batches, chunks
from starfold.llm.hashing import RangeHash, mix
from starfold.llm.scratch import Scratch
from starfold.llm.words import WordSplitter, places_in

K, WINDOW = 6, 12  # every run of 17 equal words shares a seed
MIN_WORDS, IDENTITY = 50, 0.8
_CHAIN_WORDS = 14
_GAP_COST = 0.1
_DROP = 12
_BROADCAST_ROWS = 200_000
_LAST = np.uint64((1 << 64) - 1)


def document_key(docs: DataFrame, id_column: str, text_column: str) -> Column:
    """64 bits of id and text: equal rows are one document, whatever their number, and null ids need no care.

    Whole numbers below 2**47 keep their order, with 16 bits of the text behind them, so of two documents the one with
    the smaller id has the smaller key; all other ids come after, as hashes.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(id_column).cast("string"), F.col(text_column)), 1)
    if docs.schema[id_column].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return hashed
    number = F.col(id_column).cast("long")
    ordered = F.shiftleft(number, 16).bitwiseOR(F.xxhash64(F.col(text_column)).bitwiseAND(F.lit(0xFFFF).cast("long")))
    return F.when(number.between(0, (1 << 47) - 1), ordered.bitwiseOR(F.lit(-1 << 63))).otherwise(hashed)


def winnow(grams: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Which k-mers are the smallest of some window of their text. ``first`` is each text's first k-mer, and their number.

    A shorter text has one window. The choice depends on the words of a window alone.
    """
    sizes = np.diff(first)
    n = len(sizes)
    if not len(grams):
        return np.empty(0, np.int64)
    shift = np.repeat(np.arange(n) * (window - 1), sizes) + window - 1
    padded = np.full(len(grams) + (n + 1) * (window - 1), _LAST, np.uint64)
    places = np.arange(len(grams)) + shift
    padded[places] = grams
    lowest = _sliding(padded, window, np.minimum)  # of the window that starts here
    # A k-mer is picked if it equals the largest minimum of the windows that it lies in, empty ones left out.
    within = np.where(lowest == _LAST, np.uint64(0), lowest)
    front = np.concatenate([np.zeros(window - 1, np.uint64), within])
    highest = _sliding(front, window, np.maximum)[:len(padded)]
    return np.flatnonzero(highest[places] == grams)


def _sliding(values: np.ndarray, window: int, pick) -> np.ndarray:
    """``pick`` over each window, by its start; windows at the end are shorter."""
    found, width = values, 1
    while width < window:
        step = min(width, window - width)
        found = np.concatenate([pick(found[:-step], found[step:]), found[-step:]]) if len(found) > step else found
        width += step
    return found


def seeds(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``seed``, ``key`` and ``pos`` of the picked k-mers; ``pos`` is -1 - pos where a seed comes again in its text."""
    rows = docs.select(document_key(docs, id_column, text_column).alias("key"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, range_hash = WordSplitter(), RangeHash()
        for batch in chunks(batches, "text"):
            words = split(batch.column(1))
            runs = np.maximum(np.diff(words.first) - K + 1, 0)
            first = np.concatenate([[0], np.cumsum(runs)])
            owner = np.repeat(np.arange(len(runs)), runs)
            pos = np.arange(len(owner)) - first[owner]
            starts = words.first[owner] + pos
            grams = range_hash(words.hashes, starts, starts + K)
            picked = winnow(grams, first, WINDOW)
            grams, owner, pos = grams[picked], owner[picked], pos[picked]
            again = pd.Series(mix(grams + mix(owner.astype(np.uint64)))).duplicated().to_numpy()
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({
                "seed": pa.array(grams.view(np.int64)), "key": pa.array(keys[owner]),
                "pos": pa.array(np.where(again, -1 - pos, pos), pa.int32())})

    return rows.mapInArrow(run, "seed long, key long, pos int")


def anchors(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Matches (key, pos, other, other_pos) of each occurrence of a shared seed with its place in the smallest document,
    which may be its own.

    The places are written first, so that both sides of the join are shuffled for it, and Spark can split a hot seed.
    """
    first = F.when(F.col("pos") >= 0, F.col("key"))
    heads = found.groupBy("seed").agg(F.min("key").alias("other"), F.max("key").alias("last"),
                                      F.min_by("pos", first).alias("other_pos")).filter("other <> last")
    heads = scratch.write(heads.select("seed", "other", "other_pos"), "heads")
    joined = found.join(heads, "seed")
    pos = F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos"))
    return joined.select("key", "other", pos.alias("pos"), "other_pos")


class Fenwick:
    """The largest value, and what it came with, over all places up to one."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, item: int) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place][0]:
                self.best[place] = (value, item)
            place += place & -place

    def up_to(self, place: int) -> tuple[float, int]:
        found, place = (float("-inf"), -1), place + 1
        while place > 0:
            if self.best[place][0] > found[0]:
                found = self.best[place]
            place -= place & -place
        return found


def chain(segments: list[tuple[int, int, int]], k: int = K, cost: float = _GAP_COST) -> list[list[int]]:
    """Collinear chains of segments (start, other start, length), best first; each segment is in one chain.

    A chain's score is the words that it covers less ``cost`` for each word of its gaps on either side. As gap costs are
    a sum over both sides, the best predecessor is a prefix maximum. Segments may overlap by less than a k-mer.
    """
    n = len(segments)
    ends = [(q + size - k + 1, r + size - k + 1) for q, r, size in segments]
    ranks = sorted({r for _, r in ends})
    place = {r: i for i, r in enumerate(ranks)}
    tree = Fenwick(len(ranks))
    by_start = sorted(range(n), key=lambda i: (segments[i][0], segments[i][1]))
    by_end = sorted(range(n), key=lambda i: ends[i])
    score, before, put = [0.0] * n, [-1] * n, 0
    for i in by_start:
        q, r, size = segments[i]
        while put < n and ends[by_end[put]][0] <= q:
            j = by_end[put]
            tree.put(place[ends[j][1]], score[j] + cost * sum(ends[j]), j)
            put += 1
        value, j = tree.up_to(bisect_right(ranks, r) - 1)
        value -= cost * (q + r)
        score[i], before[i] = (size + value, j) if value > 0 else (float(size), -1)
    chains, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(i)
            i = before[i]
        if found:
            chains.append(found[::-1])
    return chains


def chains(matches: DataFrame, k: int = K) -> DataFrame:
    """Chains of each pair of documents: ``key``, ``other``, and the starts and lengths of their segments. Where ``other``
    is null, ``q`` and ``r`` are starts and ends of the stretches of ``key`` that are covered by shared seeds.

    Matches arrive in order, and only the document at hand is held, so memory follows the longest document.
    """
    rows = matches.repartition("key").sortWithinPartitions("key", "other", "pos", "other_pos")

    def both(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _stretched(table)
        pairs = table[:, table[0] != table[1]]
        if pairs.shape[1]:
            yield _chained(pairs, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            last = np.flatnonzero(table[0] != table[0, -1]) if table.shape[1] else []
            if held and table.shape[1] and not len(last) and held[-1][0, -1] == table[0, 0]:
                held.append(table)
                continue
            cut = int(last[-1]) + 1 if len(last) else 0
            done = np.concatenate([*held, table[:, :cut]], axis=1)
            held = [table[:, cut:]] if table.shape[1] else [done]
            if table.shape[1] and done.shape[1]:
                yield from both(done)
        if held and held[-1].shape[1]:
            yield from both(np.concatenate(held, axis=1))

    return rows.mapInArrow(run, "key long, other long, q array<int>, r array<int>, size array<int>")


def _stretched(table: np.ndarray) -> pa.RecordBatch:
    """Where a passage may lie: a passage shares one seed of each window, so its ends are within a window of seeds."""
    order = np.lexsort((table[2], table[0]))
    key, q = table[0][order], table[2][order]
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (q[1:] - q[:-1] > WINDOW)]))
    start, end = np.maximum(q[at] - WINDOW + 1, 0), q[np.append(at[1:], len(q)) - 1] + K + WINDOW - 1
    first = np.flatnonzero(np.diff(key[at], prepend=key[0] - 1))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_pydict({
        "key": pa.array(key[at][first]), "other": pa.nulls(len(first), pa.int64()), "q": lists(start), "r": lists(end),
        "size": pa.nulls(len(first), pa.list_(pa.int32()))})


def _chained(table: np.ndarray, k: int) -> pa.RecordBatch:
    key, other, q, r = table
    new_pair = np.ones(len(key), bool)
    new_pair[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    new = new_pair.copy()
    # Matches on one diagonal, close to one another, are one segment.
    new[1:] |= (q[1:] - r[1:] != q[:-1] - r[:-1]) | (q[1:] - q[:-1] > max(WINDOW + K, k))
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(key)) - 1
    size = q[end] - q[at] + k
    pair = np.flatnonzero(new_pair[at])
    pair_end = np.append(pair[1:], len(at))
    found = {"key": [], "other": [], "q": [], "r": [], "size": []}
    starts, others, sizes = q[at].tolist(), r[at].tolist(), size.tolist()
    for s, e in zip(pair.tolist(), pair_end.tolist()):
        segments = list(zip(starts[s:e], others[s:e], sizes[s:e]))
        linked = [[0]] if e - s == 1 else chain(segments)
        linked = [x for x in linked if segments[x[-1]][0] + segments[x[-1]][2] - segments[x[0]][0] >= _CHAIN_WORDS]
        for x in linked + _periodic(segments, linked):
            found["key"].append(int(key[at[s]]))
            found["other"].append(int(other[at[s]]))
            for i, name in enumerate(("q", "r", "size")):
                found[name].append([segments[y][i] for y in x])
    kinds = {"key": pa.int64(), "other": pa.int64()}
    return pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.list_(pa.int32()))) for n, v in found.items()})


def _periodic(segments: list[tuple[int, int, int]], linked: list[list[int]]) -> list[list[int]]:
    """The first segment of each stretch that is covered without being chained, as one chain.

    Where few words repeat over and over, all places match the same few of the other document, and none are in order.
    Alignment extends the first of them as far as both documents go on.
    """
    found, covered, i = [], sorted(segments[x[0]][0] for x in linked), 0
    while i < len(segments):
        j, end = i, segments[i][0] + segments[i][2]
        while j + 1 < len(segments) and segments[j + 1][0] <= end:
            j += 1
            end = max(end, segments[j][0] + segments[j][2])
        at = bisect_right(covered, segments[i][0] - 1)
        if end - segments[i][0] >= _CHAIN_WORDS and not (at < len(covered) and covered[at] < end):
            found.append([i])
        i = j + 1
    return found


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; a word of bits holds a whole row of the table."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of the words of a gap."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (same := int((a == b).sum())) >= len(a) - 1:
        return same
    return common_subsequence(a.tolist(), b.tolist())


def _extend(a: np.ndarray, b: np.ndarray, cost: float) -> tuple[int, int]:
    """How far two sequences agree from their start, but for single words, and in how many words. A changed word costs
    as many equal ones as keep the identity."""
    n, size = min(len(a), len(b)), 256
    while True:
        same = a[:min(n, size)] == b[:min(n, size)]
        score = np.cumsum(np.where(same, 1, -cost))
        drop = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > _DROP)
        if len(drop) or size >= n:
            break
        size *= 4
    stop = int(drop[0]) if len(drop) else n
    if stop == 0 or score[:stop].max() <= 0:
        return 0, 0
    best = int(score[:stop].argmax()) + 1
    return best, int(same[:best].sum())


def _stretches(score: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches of steps whose scores are not below 0 in sum, in order; they may overlap."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    lowest = np.minimum.accumulate(total)
    starts = np.flatnonzero(np.concatenate([[True], total[1:] < lowest[:-1] - 1e-9]))
    highest = np.maximum.accumulate(total[::-1])  # from the end
    ends = len(total) - 1 - np.searchsorted(highest, total[starts] - 1e-9)
    found = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        if end > start and not (found and found[-1][1] >= end):
            found.append((start, end))
    return found


def align(a: np.ndarray, b: np.ndarray, q: list[int], r: list[int], size: list[int], identity: float = IDENTITY
          ) -> list[tuple[int, int, int, int, float]]:
    """Start and end in words on either side, and the share of equal words, of all maximal stretches of a chain in which
    that share is ``identity`` or more, extended to their ends."""
    # Steps of the alignment: each word of a segment, and each gap between two.
    here, there, equal = [], [], []
    at, to = q[0], r[0]
    for x, y, n in zip(q, r, size):
        skip = max(at - x, to - y, 0)
        if skip >= n:
            continue
        x, y, n = x + skip, y + skip, n - skip
        if x > at or y > to:
            here.append([x - at])
            there.append([y - to])
            equal.append([_common(a[at:x], b[to:y])])
        here.append(np.ones(n, np.int64))
        there.append(np.ones(n, np.int64))
        equal.append(a[x:x + n] == b[y:y + n])
        at, to = x + n, y + n
    here, there, equal = (np.concatenate(x).astype(np.int64) for x in (here, there, equal))
    place, other = (np.concatenate([[first], first + np.cumsum(x)]) for first, x in ((q[0], here), (r[0], there)))
    cost = identity / max(1 - identity, 1e-6)
    whole = (here == 1) & (there == 1) & (equal == 1)
    found = []
    for s, e in _stretches(equal - identity * np.maximum(here, there)):
        ends = np.flatnonzero(whole[s:e])
        if not len(ends):
            continue
        s, e = s + int(ends[0]), s + int(ends[-1]) + 1
        left, before = _extend(a[:place[s]][::-1], b[:other[s]][::-1], cost)
        right, after = _extend(a[place[e]:], b[other[e]:], cost)
        start, end, other_start, other_end = place[s] - left, place[e] + right, other[s] - left, other[e] + right
        share = (before + int(equal[s:e].sum()) + after) / max(end - start, other_end - other_start, 1)
        found.append((int(start), int(end), int(other_start), int(other_end), float(share)))
    return found


def _texts(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Key and text of the wanted documents. Reads ``docs`` again; only wanted texts are kept."""
    if wanted.count() <= _BROADCAST_ROWS:  # else both sides are shuffled
        wanted = F.broadcast(wanted)
    rows = docs.select(document_key(docs, id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    return rows.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def passages(docs: DataFrame, scratch: Scratch, *, min_words: int = MIN_WORDS, identity: float = IDENTITY,
             id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Passages of ``key`` that ``other`` has too, by characters: ``start``, ``end``, ``other_start``, ``other_end``, and
    ``first_word``, ``n_words`` and ``identity``. ``other`` is always the document with the smaller key."""
    bounded_batches(docs.sparkSession)
    found = scratch.write(seeds(docs, id_column, text_column), "seeds")
    linked = scratch.write(chains(anchors(found, scratch)), "chains")
    scratch.drop(found)
    spans = _aligned(docs, linked.filter("other is not null"), scratch, min_words, identity, id_column, text_column)
    found = scratch.write(_runs(docs, linked.filter("other is null"), spans, min_words, id_column, text_column), "runs")
    scratch.drop(linked)
    linked = scratch.write(chains(anchors(found, scratch), min_words).filter("other is not null"), "run-chains")
    scratch.drop(found)
    more = _aligned(docs, linked, scratch, min_words, identity, id_column, text_column)
    scratch.drop(linked)
    old = spans.select("key", F.col("start").alias("from"), F.col("end").alias("to"))
    more = more.join(old, (more["key"] == old["key"]) & (F.col("from") <= F.col("start")) & (F.col("end") <= F.col("to")),
                     "left_anti")
    return spans.unionByName(more)


def _runs(docs: DataFrame, stretches: DataFrame, spans: DataFrame, min_words: int, id_column: str, text_column: str
          ) -> DataFrame:
    """All runs of ``min_words`` words within the stretches, but those in passages that are listed word for word, as
    ``seeds``. Those that are listed are in a smaller document too, so the smallest that has a run is always here."""
    listed = spans.filter("identity = 1").groupBy("key").agg(
        F.collect_set(F.struct("first_word", "n_words")).alias("listed"))
    rows = stretches.select("key", "q", "r").filter(F.exists(F.zip_with("q", "r", lambda q, r: r - q), lambda n: n >= min_words))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for key, q, r, listed in zip(*(c.to_pylist() for c in batch.columns)):
                open_ = np.zeros(max(r) + 2, np.int8)  # of each word, whether a run may start there
                for s, e in zip(q, r):
                    open_[s + 1:max(e - min_words + 2, 0)] = 1
                for x in listed or ():
                    open_[x["first_word"] + 1:x["first_word"] + x["n_words"] - min_words + 2] = 0
                edge = np.diff(open_, append=np.int8(0))
                if edge.any():
                    keys.append(key)
                    starts.append(np.flatnonzero(edge == 1))
                    ends.append(np.flatnonzero(edge == -1))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "first": pa.array(starts, pa.list_(pa.int32())),
                                                  "last": pa.array(ends, pa.list_(pa.int32()))})

    rows = rows.join(listed, "key", "left").mapInArrow(left, "key long, first array<int>, last array<int>")
    texts = docs.select(document_key(docs, id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    rows = texts.join(rows, "key").select("key", "text", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, range_hash = WordSplitter(), RangeHash()
        for batch in chunks(batches, "text"):
            words = split(batch.column(1))
            sizes = np.diff(words.first)
            pos = [np.concatenate([np.arange(s, min(e, n - min_words + 1)) for s, e in zip(first, last)])
                   for first, last, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), sizes.tolist())]
            owner = np.repeat(np.arange(len(pos)), [len(p) for p in pos])
            pos = np.concatenate([*pos, np.empty(0)]).astype(np.int64)
            starts = words.first[owner] + pos
            grams = range_hash(words.hashes, starts, starts + min_words)
            again = pd.Series(mix(grams + mix(owner.astype(np.uint64)))).duplicated().to_numpy()
            yield pa.RecordBatch.from_pydict({
                "seed": pa.array(grams.view(np.int64)), "key": pa.array(batch.column(0).to_numpy()[owner]),
                "pos": pa.array(np.where(again, -1 - pos, pos), pa.int32())})

    return rows.mapInArrow(run, "seed long, key long, pos int")


def _aligned(docs: DataFrame, linked: DataFrame, scratch: Scratch, min_words: int, identity: float, id_column: str,
             text_column: str) -> DataFrame:
    """The passages that chains lead to."""
    wanted = linked.select(F.explode(F.array("key", "other")).alias("key")).distinct()
    texts = scratch.write(_texts(docs, wanted, id_column, text_column), "texts")
    pairs = linked.groupBy("key", "other").agg(F.collect_list(F.struct("q", "r", "size")).alias("chains"))
    rows = pairs.join(texts.withColumnRenamed("text", "text_a"), "key").join(
        texts.select(F.col("key").alias("other"), F.col("text").alias("text_b")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = WordSplitter()
        names = ("key", "other", "start", "end", "other_start", "other_end", "first_word", "n_words", "identity")
        kinds = (*(pa.int64(),) * 2, *(pa.int32(),) * 6, pa.float64())
        for batch in chunks(batches, "text_a"):
            sides = [split(batch.column(i)) for i in (3, 4)]
            texts = [batch.column(i) for i in (3, 4)]
            found = []
            for i, linked in enumerate(batch.column(2).to_pylist()):
                a, b = (s.hashes[s.first[i]:s.first[i + 1]] for s in sides)
                aligned = {x for c in linked for x in align(a, b, c["q"], c["r"], c["size"], identity)}
                aligned = sorted(x for x in aligned if x[1] - x[0] >= min_words and x[4] >= identity - 1e-9)
                if aligned:
                    (one, two) = (_characters(t[i].as_py()) for t in texts)
                    found += [(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), one(s, 0), one(e - 1, 1),
                               two(os, 0), two(oe - 1, 1), s, e - s, share) for s, e, os, oe, share in aligned]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), kinds)], names=list(names))

    rows = rows.select("key", "other", "chains", "text_a", "text_b")
    spans = scratch.write(rows.mapInArrow(run, "key long, other long, start int, end int, other_start int, other_end int, "
                                               "first_word int, n_words int, identity double"), "spans")
    scratch.drop(texts)
    return spans


def _characters(text: str):
    """The first character of a word, or the one after its last."""
    raw, starts, ends = places_in(text)
    character = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return lambda word, end: int(character[(ends if end else starts)[word]])


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, identity: float = IDENTITY,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Passages of ``min_words`` or more that a document shares with another, with ``identity`` equal words at least.

    Columns: the id, ``start`` and ``end`` in characters, ``n_words``, ``identity``, and ``other_id``, ``other_start``,
    ``other_end``. Of all documents that hold a passage, one is never listed for it, but as ``other_id``.

    Texts that are null, empty or shorter than ``min_words`` have no passages. Rows that repeat id and text are one
    document; repeats within one document do not count. Null ids stay null. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    spans = passages(docs, scratch, min_words=min_words, identity=identity, id_column=id_column, text_column=text_column)
    ids = docs.select(document_key(docs, id_column, text_column).alias("key"), F.col(id_column).alias("id")).distinct()
    ids = scratch.write(ids, "ids")
    other = ids.select(F.col("key").alias("other"), F.col("id").alias("other_id"))
    return spans.join(ids, "key").join(other, "other").select(
        F.col("id").alias(id_column), "start", "end", "n_words", "identity", "other_id", "other_start", "other_end")


def without_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, identity: float = IDENTITY,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the texts of all documents but one. All rows and columns stay; a text
    that is nothing but a repeat becomes empty, and a text without repeats stays as it is."""
    scratch = Scratch(docs.sparkSession, "substring")
    spans = passages(docs, scratch, min_words=min_words, identity=identity, id_column=id_column, text_column=text_column)
    cuts = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = scratch.write(cuts.withColumnRenamed("key", "cut_key"), "cuts")
    if cuts.count() <= _BROADCAST_ROWS:  # else both sides are shuffled
        cuts = F.broadcast(cuts)
    joined = docs.join(cuts, document_key(docs, id_column, text_column) == F.col("cut_key"), "left")
    # What lies between the cuts: each begins where all cuts before it have ended.
    text = F.col(text_column)
    step = lambda done, cut: F.struct(
        F.when(cut["start"] > done["at"], F.concat(done["text"], F.substring(text, done["at"] + 1, cut["start"] - done["at"])))
        .otherwise(done["text"]).alias("text"), F.greatest(done["at"], cut["end"]).alias("at"))
    rest = lambda done: F.concat(done["text"], F.substring(text, done["at"] + 1, F.length(text)))
    cleaned = F.aggregate("cuts", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step, rest)
    columns = [F.when(F.col("cuts").isNull(), text).otherwise(cleaned).alias(c) if c == text_column else F.col(c)
               for c in docs.columns]
    return joined.select(*columns)
