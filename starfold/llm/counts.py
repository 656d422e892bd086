"""Token counts by rank-synchronous merging of many pre-tokens at once, in numpy.

All distinct pre-tokens of a chunk lie behind one another in one array of symbols. In each round, every pre-token
merges all places of its own lowest-ranked pair, from left to right; pre-tokens without a pair that can be merged
are done. What remains are their tokens, so counting needs no ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starfold.llm.arrow import bounded_batches, chunks
from starfold.llm.bpe import byte_table
from starfold.llm.pretokens import Memo, Splitter, character_classes, tokenizers_joins

_NEVER = np.int64(1 << 40)


class Merges:
    """The pairs of a vocabulary in sorted arrays: which rank a pair has, and which symbol it becomes."""

    def __init__(self, definition: str) -> None:
        model = json.loads(definition)["model"]
        vocabulary = model["vocab"]
        self.size = max(vocabulary.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order]
        self.of_byte = np.array([vocabulary[c] for c in byte_table()], np.int64)
        # A pre-token that is itself an entry is taken whole, where the definition says so.
        self.whole = frozenset(vocabulary) if model.get("ignore_merges") else frozenset()

    def rank(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ranks[at], _NEVER), self.merged[at]


def merge_all(symbols: np.ndarray, owner: np.ndarray, merges: Merges, n: int) -> np.ndarray:
    """How many symbols each of ``n`` sequences keeps. ``owner`` is the sequence of each symbol, ascending."""
    counts = np.bincount(owner, minlength=n)
    if not len(merges.keys):
        return counts
    while len(symbols) > 1:
        together = owner[1:] == owner[:-1]
        ranks, merged = merges.rank(symbols[:-1] * merges.size + symbols[1:])
        ranks = np.append(np.where(together, ranks, _NEVER), _NEVER)
        first = np.flatnonzero(np.concatenate([[True], ~together]))
        sizes = np.diff(np.append(first, len(symbols)))
        lowest = np.minimum.reduceat(ranks, first)
        hit = (ranks == np.repeat(lowest, sizes)) & (ranks < _NEVER)
        at = np.flatnonzero(hit)
        if not len(at):
            break
        # In a row of overlapping places, every second one merges.
        new_row = np.concatenate([[True], np.diff(at) > 1])
        row_start = np.flatnonzero(new_row)
        place = np.arange(len(at)) - np.repeat(row_start, np.diff(np.append(row_start, len(at))))
        at = at[place % 2 == 0]
        counts -= np.bincount(owner[at], minlength=n)
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        keep &= np.repeat(lowest < _NEVER, sizes)  # the others are done
        symbols, owner = symbols[keep], owner[keep]
    return counts


class Counter:
    """Token counts of chunks of texts. One for each task."""

    def __init__(self, definition: str, classes: np.ndarray) -> None:
        self.merges, self.split, self.memo = Merges(definition), Splitter(classes), Memo(self._counts)
        special = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        special.sort(key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _counts(self, pieces: list[str]) -> list[tuple[int]]:
        raw = [p.encode() for p in pieces]
        owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
        symbols = self.merges.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        found = merge_all(symbols, owner, self.merges, len(raw))
        if self.merges.whole:
            table = byte_table()
            for i, r in enumerate(raw):
                if "".join(table[b] for b in r) in self.merges.whole:
                    found[i] = 1
        return [(c,) for c in found.tolist()]

    def __call__(self, texts: list[str]) -> np.ndarray:
        pieces, owner, more = texts, None, np.zeros(len(texts), np.int64)
        if self.special:  # a special string is one token, and the text on either side is cut on its own
            parts = [self.special.split(t) for t in texts]
            more = np.array([len(p) // 2 for p in parts], np.int64)
            owner = np.repeat(np.arange(len(parts)), [len(p) // 2 + 1 for p in parts])
            pieces = [piece for p in parts for piece in p[::2]]
        found = self.split(pieces)
        slots = self.memo.look_up(found)
        total = np.concatenate([[0], np.cumsum(self.memo.flat[slots])])[found.first]
        each = np.diff(total)
        return more + (np.bincount(owner, each, len(texts)).astype(np.int64) if owner is not None else each)


def count_tokens(docs: DataFrame, definition: str, *, limit: int = 1024, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``definition`` is the JSON of a byte-level BPE tokenizer. Its special strings count as one token each, which is
    the library's default; nothing is added, cut off or padded. A null text counts as empty. Null ids and repeated
    rows come back as they are; an empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # A vocabulary and a fixed table. Each worker process keeps its copy, and its counter in it, from task to task.
    shared = spark.sparkContext.broadcast({"arguments": (definition, character_classes(tokenizers_joins(definition)))})
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if "counter" not in own:
            own["counter"] = Counter(*own["arguments"])
        counter = own["counter"]
        for batch in chunks(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                id_column: batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(counter(texts), pa.int64())})

    kind = docs.schema[id_column].dataType.simpleString()
    counted = rows.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
