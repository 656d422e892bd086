"""Token ids packed into rows of a fixed length by best-fit-decreasing, written as binary matrices.

Documents are packed in pools as they are read: a task collects documents until a pool is full, packs it, writes its
rows and goes on. A pool is large against a row, so little is lost at its end, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from starfold.llm.arrow import bounded_batches, chunks
from starfold.llm.bpe import Encoder, token_bytes
from starfold.llm.pretokens import character_classes, tiktoken_joins

LENGTH, POOL_TOKENS = 2_048, 4_000_000
SCHEMA = ("part int, pool int, row int, tokens binary, width int, n_tokens int, cu_seqlens array<int>, "
          "resets array<int>, doc_ids array<long>, doc_starts array<int>")


class OpenRows:
    """Rows by the room they have left. A segment tree over room finds the tightest row that fits."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return a row with the least room of at least ``size``, and its room."""
        count, at = self.count, size + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until there is something on the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return row, room


def best_fit_decreasing(sizes: Sequence[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: longest pieces first, each into the row that it fills best, else into a new one.

    No piece may be longer than a row. Pieces of equal size keep their order.
    """
    rows: list[list[int]] = []
    open_rows = OpenRows(length)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        found = open_rows.take(size)
        if found is None:
            rows.append([])
            found = (len(rows) - 1, length)
        row, room = found
        rows[row].append(piece)
        if room > size:
            open_rows.put(row, room - size)
    return rows


def cut(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and size of each piece: overlong documents become full rows and a rest. Nothing is lost."""
    pieces = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return owner, nth * length, np.minimum(sizes[owner] - nth * length, length)


def _pack(ids: np.ndarray, ends: np.ndarray, doc_ids: list, length: int, pad: int, kind: str, part: int, pool: int
          ) -> Iterator[pa.RecordBatch]:
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    owner, at, sizes = cut(ends - starts, length)
    rows = best_fit_decreasing(sizes.tolist(), length)
    schema = pa.schema([("part", pa.int32()), ("pool", pa.int32()), ("row", pa.int32()), ("tokens", pa.binary()),
                        ("width", pa.int32()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
                        ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
                        ("doc_starts", pa.list_(pa.int32()))])
    for first in range(0, len(rows), 256):
        records = []
        for number, pieces in enumerate(rows[first:first + 256], first):
            matrix = np.full(length, pad, kind)
            borders = [0]
            for p in pieces:
                source = int(starts[owner[p]] + at[p])
                matrix[borders[-1]:borders[-1] + sizes[p]] = ids[source:source + sizes[p]]
                borders.append(borders[-1] + int(sizes[p]))
            records.append({"part": part, "pool": pool, "row": number, "tokens": matrix.tobytes(),
                            "width": matrix.itemsize, "n_tokens": borders[-1], "cu_seqlens": borders,
                            "resets": borders[:-1], "doc_ids": [doc_ids[owner[p]] for p in pieces],
                            "doc_starts": [int(at[p]) for p in pieces]})
        yield pa.RecordBatch.from_pylist(records, schema=schema)


def pack(docs: DataFrame, definition: str, pattern: str, *, length: int = LENGTH, pad: int = 50_256,
         pool_tokens: int = POOL_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packed rows of ``length`` ids each.

    ``tokens`` holds the ids as little-endian integers of ``width`` bytes, two where all ids of ``definition`` and ``pad`` fit
    in them, else four, the end filled with ``pad``; ``n_tokens`` are
    real. Segment i goes from ``cu_seqlens[i]`` to ``cu_seqlens[i + 1]``, positions count from 0 again at each of
    ``resets``, and it holds the ids of ``doc_ids[i]`` from ``doc_starts[i]`` on. A row is known by part, pool and row.

    A null text counts as empty; documents without ids have no segment. A text of any length is cut into full rows
    and a rest. Null ids stay null and repeated rows are packed as often as they come. An empty table gives no rows;
    other columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not 0 <= pad < 1 << 31:
        raise ValueError(f"no id: {pad}")
    kind = "<u2" if max(pad, len(token_bytes(definition)) - 1) < 1 << 16 else "<u4"
    # A vocabulary and a fixed table. Each worker process keeps its copy, and its encoder in it, from task to task.
    shared = spark.sparkContext.broadcast({"arguments": (definition, character_classes(tiktoken_joins(pattern)))})
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if "encoder" not in own:
            own["encoder"] = Encoder(*own["arguments"])
        part, pool, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            ids = np.concatenate([h[0] for h in held])
            shift = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            ends = np.concatenate([h[1] + s for h, s in zip(held, shift)])
            return _pack(ids, ends, [i for h in held for i in h[2]], length, pad, kind, part, pool)

        for batch in chunks(batches, "text"):
            ids, ends = own["encoder"].ids([t or "" for t in batch.column(1).to_pylist()])
            held.append((ids.astype(np.dtype(kind)), ends, batch.column(0).to_pylist()))
            size += len(ids)
            if size >= pool_tokens:
                yield from packed()
                pool, held, size = pool + 1, [], 0
        if held:
            yield from packed()

    return rows.mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, one row a record."""
    packed.write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """One row per segment: the document, where the segment starts in it, its row, its place there, and its bytes."""
    row = packed.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("doc_ids") - 1)))
    start, end = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    row = row.select(F.get("doc_ids", F.col("i")).alias("doc_id"), F.get("doc_starts", F.col("i")).alias("doc_start"),
                     "part", "pool", "row", start.alias("row_start"), (end - start).alias("n_tokens"), "width", "tokens")
    raw = F.expr("substring(tokens, row_start * width + 1, n_tokens * width)")
    return row.select("doc_id", "doc_start", "part", "pool", "row", "row_start", "n_tokens", raw.alias("ids"))
