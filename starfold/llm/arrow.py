"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1_000_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let the session send at most ``rows`` rows at once to Python. Texts are long, and a batch is held in full."""
    if int(spark.conf.get(_BATCH_ROWS)) > rows:
        spark.conf.set(_BATCH_ROWS, rows)


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of a class of this package to executors that have no copy of it; ``received`` gives it back.

    Spark pickles a broadcast by the names of its classes, so they are sent along in bytes of their own.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shipped: Broadcast) -> object:
    return pickle.loads(shipped.value)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold about ``limit`` bytes; a longer text is a piece of its own.

    Slices share memory with their batch, so working memory follows the limit and the longest text.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        n = len(texts)
        if n == 0:
            continue
        ends = np.cumsum(lengths(texts))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the end of each list."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, counts)


def at_most(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (``id``, ``text`` and more) as they are, or where they are over twice ``limit``, about ``limit`` of those that
    differ, drawn by a hash of the text: the bound of a sample that was drawn by ids, if an id has very many rows."""
    n = rows.select("id").count()
    if n <= 2 * limit:
        return rows
    share = F.pmod(F.xxhash64("text", "id", F.lit("sample")), F.lit(1_000_003)) < limit / n * 1_000_003
    return rows.filter(share).dropDuplicates(["id", "text"])
