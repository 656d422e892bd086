"""Which filters a document fails, and what each filter does in every order that they could be applied in.

A table of byte classes and states drives one pass over the UTF-8 bytes of a batch of texts: it counts words,
capitals, code points and symbols, and hands over the span of each word. Spans go into a hash table, where an
entry is only taken for the same word after its bytes were compared, so the counts of distinct words are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starfold.llm.arrow import bounded_batches, chunks, lengths
from starfold.llm.hashing import mix
from starfold.llm.scratch import Scratch

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
_SPACE, _OTHER, _CAPITAL, _SYMBOL, _INNER, _CLASSES = 0, 1, 2, 3, 4, 5
_OUTSIDE, _INSIDE = 0, 1  # states: between words, in a word
_NOTHING, _BEGIN, _END = 0, 1, 2  # what a step does with a word
_LANE = 8
_SHORT = 64  # longer words are rare and compared as bytes


def byte_classes() -> np.ndarray:
    """The class of each byte. Bytes inside a character only matter in that they start no code point."""
    classes = np.full(256, _OTHER, np.uint8)
    classes[0x80:0xC0] = _INNER
    classes[ord("A"):ord("Z") + 1] = _CAPITAL
    classes[list(SYMBOLS)] = _SYMBOL
    classes[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return classes


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """For state and class: the next state, and what the step does."""
    after = np.full((2, _CLASSES), _INSIDE, np.uint8)
    after[:, _SPACE] = _OUTSIDE
    action = np.zeros((2, _CLASSES), np.uint8)
    action[_OUTSIDE, 1:] = _BEGIN
    action[_INSIDE, _SPACE] = _END
    return after, action


class Transducer:
    """Counts of texts and the spans of their words, from one pass of the tables over their joined bytes.

    The next state depends on the class alone, whatever the state before, so all steps are taken at once: the state
    before a byte is that after the byte before it. Each text ends in a space of its own, which is not counted.
    """

    def __init__(self) -> None:
        self.classes, (self.after, self.action) = byte_classes(), transitions()
        assert (self.after[_OUTSIDE] == self.after[_INSIDE]).all()

    def __call__(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text capitals, code points and symbols; first byte and end of each word. ``ends``: after each closing space."""
        kinds = self.classes[raw]
        state = np.empty(len(raw), np.uint8)  # before each byte
        state[:1] = _OUTSIDE
        state[1:] = self.after[_OUTSIDE][kinds[:-1]]
        action = self.action.ravel()[state * np.uint8(_CLASSES) + kinds]
        # At most one of these for each byte, so a running sum of flags counts each kind.
        def per_text(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[np.concatenate([[0], ends])]
            return np.diff(total)

        counts = np.column_stack([per_text(kinds == _CAPITAL), per_text(kinds != _INNER) - 1, per_text(kinds == _SYMBOL)])
        return counts, np.flatnonzero(action == _BEGIN), np.flatnonzero(action == _END)


class WordTable:
    """How many different words each text has. One table for a batch, emptied for the next one."""

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        size = ends - starts
        padded = np.concatenate([raw, np.zeros(_LANE, np.uint8)])
        lane_at = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))  # eight bytes from any place on
        hashes = mix(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        long = np.flatnonzero(size > _SHORT)
        for w in long.tolist():
            hashes[w] ^= np.uint64(hash(raw[starts[w]:ends[w]].tobytes()) & 0xFFFFFFFFFFFFFFFF)
        lane, left = 0, np.flatnonzero(size <= _SHORT)
        while len(left):
            hashes[left] = mix(hashes[left] ^ self._lane(lane_at, starts[left], size[left], lane))
            lane += 1
            left = left[size[left] > lane * _LANE]
        return self._insert(raw, lane_at, starts, size, owner, hashes, texts)

    @staticmethod
    def _lane(lane_at: np.ndarray, starts: np.ndarray, size: np.ndarray, lane: int) -> np.ndarray:
        """Bytes ``8 * lane`` to ``8 * lane + 7`` of each word, those behind its end zero."""
        unused = np.maximum((lane + 1) * _LANE - size, 0).astype(np.uint64) * np.uint64(8)
        return lane_at[starts + lane * _LANE] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused)

    def _same(self, raw, lane_at, starts, size, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` have the same bytes."""
        same = size[a] == size[b]
        left, lane = np.flatnonzero(same & (size[a] <= _SHORT)), 0
        while len(left):
            x, y = a[left], b[left]
            equal = self._lane(lane_at, starts[x], size[x], lane) == self._lane(lane_at, starts[y], size[y], lane)
            same[left[~equal]] = False
            lane += 1
            left = left[equal & (size[x] > lane * _LANE)]
        for i in np.flatnonzero(same & (size[a] > _SHORT)).tolist():
            x, y, n = starts[a[i]], starts[b[i]], size[a[i]]
            same[i] = raw[x:x + n].tobytes() == raw[y:y + n].tobytes()
        return same

    def _insert(self, raw, lane_at, starts, size, owner, hashes, texts: int) -> np.ndarray:
        slots = 1 << max(len(starts) * 2 - 1, 1).bit_length()
        table, mask = np.full(slots, -1, np.int64), slots - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        waiting, distinct = np.arange(len(starts)), np.zeros(texts, np.int64)
        while len(waiting):
            place = at[waiting]
            free = table[place] < 0
            table[place[free]] = waiting[free]  # of several words, one gets the place
            held = table[place]
            fresh = held == waiting
            distinct += np.bincount(owner[waiting[fresh]], minlength=texts)
            rest = np.flatnonzero(~fresh)
            word, held = waiting[rest], held[rest]
            known = (hashes[word] == hashes[held]) & (owner[word] == owner[held])
            known[known] = self._same(raw, lane_at, starts, size, word[known], held[known])
            waiting = word[~known]
            at[waiting] = (at[waiting] + 1) & mask
        return distinct


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """``words``, ``distinct_words``, ``capitals``, ``code_points`` and ``symbols`` of each text; null counts as empty."""
    texts = texts.fill_null("")
    sizes = lengths(texts)
    ends = np.cumsum(sizes + 1)
    raw = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    packed = texts.cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1]
    if len(texts) and offsets[-1] > offsets[0]:
        body = np.ones(len(raw), bool)
        body[ends - 1] = False
        raw[body] = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    counts, starts, stops = Transducer()(raw, ends)
    owner = np.searchsorted(ends, starts, "right")
    return {"words": np.bincount(owner, minlength=len(texts)), "distinct_words": WordTable()(raw, starts, stops, owner, len(texts)),
            "capitals": counts[:, 0], "code_points": counts[:, 1], "symbols": counts[:, 2]}


def text_counts(docs: DataFrame, *, keep: tuple[str, ...] = (), text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns, ``words``, ``distinct_words``, ``capitals``, ``code_points``, ``symbols``
    and ``text_digest``, the SHA-256 of the text.

    Words are maximal runs of what is neither a space nor a control character from tab to carriage return, and their case
    counts. A null text counts as empty. Rows are neither joined nor moved; a text of any length is read whole.
    """
    bounded_batches(docs.sparkSession)
    names = ["words", "distinct_words", "capitals", "code_points", "symbols"]
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)],
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_digest"), text.alias("counted_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "counted_text"):
            found = measure(batch.column(len(batch.schema) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[n], pa.int64()) for n in names]],
                                             names=[*batch.schema.names[:-1], *names])

    schema = ", ".join([*[f"kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)],
                        "text_digest binary", *[f"{n} long" for n in names]])
    counted = rows.mapInArrow(run, schema)
    return counted.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "text_digest", *names)


def failed_by_text(least_words: int = 200) -> Column:
    """Bits of the filters A to D, lowest first, from the columns of ``text_counts``."""
    failed = [F.col("words") < least_words, F.col("distinct_words") * 100 < F.col("words") * 50,
              F.col("capitals") * 100 > F.col("code_points") * 3, F.col("symbols") > 0]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)]
    return sum(bits[1:], bits[0]).cast("int")


def failures(docs: DataFrame, scratch: Scratch, *, part_column: str = "lang", id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """``doc_id``, ``part`` and ``failed`` (bits of A to E) of each row of ``docs``.

    A text repeats, and fails E, if a row with a smaller id has the same text. Rows without an id have no smaller ones
    and are none; rows of one id with the same text don't repeat each other.
    """
    rows = text_counts(docs, keep=(id_column, part_column), text_column=text_column).select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        "text_digest", failed_by_text().alias("failed"))
    rows = scratch.write(rows, "counts")
    # Only texts that occur with several ids are joined back. Written first, so that Spark can split the rows of one text.
    first = rows.groupBy(F.col("text_digest").alias("of_digest")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first = scratch.write(first.filter("first_id < last_id").drop("last_id"), "repeated")
    joined = rows.join(first, rows["text_digest"] == first["of_digest"], "left")
    repeats = F.when(F.col("doc_id") > F.col("first_id"), 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("doc_id", "part", (F.col("failed") + repeats).alias("failed"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What each filter does at each step of each of the 120 orders, per part.

    One row per ``part``, ``filter_order`` and ``step`` (the filter is that letter of the order): ``kept`` after the step,
    ``removed`` by it, ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing that filter alone),
    ``good_lost`` and ``toxic_lost`` (removed here, labelled so), and ``shapley``, the rows that the filter removes, summed
    over all orders. Every row of ``docs`` counts, repeated ones and those without an id too. A row is labelled if any
    label of its id says so; labels without an id or for unknown ids count for nothing. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "filters")
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, scratch, **columns)
    rows = rows.join(told, rows["doc_id"] == told["labelled"], "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    # From here on there are at most 128 rows a part, whatever its size.
    profiles = rows.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag("good")).alias("good"), F.count_if(flag("toxic")).alias("toxic"))
    return in_every_order(profiles)


def in_every_order(profiles: DataFrame) -> DataFrame:
    """The rows of ``audit`` from counts per ``part`` and ``failed``: ``n``, ``good`` and ``toxic``."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append(("".join(order), i + 1, bit, before))
            before |= bit
    # A fixed table of 600 steps; each row of the profiles meets all of them.
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("filter_order", "step", "bit", "before"), s)]) for s in steps])
    spread = profiles.withColumn("at", F.explode(table)).select("part", "failed", "n", "good", "toxic", "at.*")
    fails, gone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    total = lambda value, when, name: F.sum(F.when(when, value).otherwise(0)).cast("long").alias(name)
    removed = fails & ~gone
    # A row that fails k filters falls to each of them in 120 / k of the orders.
    turns = F.lit(120).cast("long") / F.greatest(F.bit_count("failed"), F.lit(1))
    return spread.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), ~fails & ~gone, "kept"), total(F.col("n"), removed, "removed"), total(F.col("n"), fails & gone, "redundant"),
        total(F.col("n"), F.col("failed") == F.col("bit"), "unique_fails"), total(F.col("good"), removed, "good_lost"),
        total(F.col("toxic"), removed, "toxic_lost"), total((F.col("n") * turns).cast("long"), fails, "shapley"))
