"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

Ranks in tiktoken's format become a model of the tokenizers library: bytes are written as printable characters
by the byte table, and each rank gives the one merge that ends in it. Each distinct pre-token of a task is encoded
once; ids are then laid out for whole chunks. Decoding looks up the bytes of each id, which undoes the byte table,
and joins the bytes before any text is made of them, so characters split over several ids come back whole.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starfold.llm.arrow import bounded_batches, chunks, gather, ragged
from starfold.llm.pretokens import Memo, Splitter, character_classes, tiktoken_joins


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    table = {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks. The file is a vocabulary, so its size does not grow with the data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by rank leaves just before it reaches the whole token."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model_json(ranks: dict[bytes, int]) -> str:
    """The ranks as a definition of the tokenizers library.

    Merging by rank always builds a token from the same two parts, so one merge for each token, in order of rank,
    gives the same ids. A pre-token that is itself in the vocabulary is taken whole.
    """
    table = byte_table()
    text = lambda token: "".join(table[b] for b in token)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
        parts = _last_merge(token, ranks) if len(token) > 1 else None
        if parts:
            merges.append([text(parts[0]), text(parts[1])])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False,
                                            "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                  "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
                  "vocab": {text(token): rank for token, rank in ranks.items()}, "merges": merges}})


class Encoder:
    """Ids, and on request character offsets, of chunks of texts. One for each task."""

    def __init__(self, definition: str, classes: np.ndarray) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.split = Splitter(classes)
        self.memo = Memo(self._encode)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        found = []
        for at in range(0, len(pieces), 5000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at:at + 5000], add_special_tokens=False)]
        return found

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the end of each text in them."""
        found = self.split(texts)
        slots = self.memo.look_up(found)
        ends = np.concatenate([[0], np.cumsum(self.memo.counts[slots])])
        return self.memo.symbols(slots), ends[found.first[1:]]


def character_offsets(texts: list[str], sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each id, and the one after its last, within its text.

    ``sizes`` are the bytes of each id. An id that holds a part of a character covers the whole character.
    """
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    stop = np.cumsum(sizes)
    start = stop - sizes
    text_start = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    shift = np.repeat(text_start, np.diff(np.concatenate([[0], ends])))
    return character[start] - shift, character[stop - 1] + 1 - shift


def encode(docs: DataFrame, definition: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text",
           offsets: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` array<int>, and with ``offsets`` also ``starts`` and ``ends``.

    A null text counts as empty and has no ids. Rows are neither joined nor moved: repeated rows and null ids come
    back as they are, an empty table gives an empty result, and other columns of ``docs`` are left out. A text of any
    length is encoded whole. ``definition`` is the JSON of a byte-level model, as ``model_json`` gives it, and
    ``pattern`` that of its pre-tokens; letters and numbers are those that tiktoken knows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # A vocabulary and a fixed table. Each worker process keeps its copy, and its encoder in it, from task to task.
    shared = spark.sparkContext.broadcast({"arguments": (definition, character_classes(tiktoken_joins(pattern)))})
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if "encoder" not in own:
            own["encoder"] = Encoder(*own["arguments"])
        encoder, sizes = own["encoder"], byte_sizes(own["arguments"][0]) if offsets else None
        for batch in chunks(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends = encoder.ids(texts)
            columns = {id_column: batch.column(0), "ids": ragged(ids, ends, pa.int32())}
            if offsets:
                start, stop = character_offsets(texts, sizes[ids], ends)
                columns |= {"starts": ragged(start, ends, pa.int32()), "ends": ragged(stop, ends, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_column].dataType.simpleString()
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>{more}")


def token_bytes(definition: str) -> list[bytes]:
    """The bytes of each id, the byte table undone; empty where an id is not in use."""
    vocabulary = json.loads(definition)["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(byte_table())}
    found = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, number in vocabulary.items():
        found[number] = bytes(byte_of[c] for c in token)
    return found


def byte_sizes(definition: str) -> np.ndarray:
    return np.fromiter(map(len, token_bytes(definition)), np.int64)


class Decoder:
    """The bytes of ids. Bytes are joined before anything reads them as text, so characters split over ids are whole."""

    def __init__(self, table: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """One value for each list of ids. ``ends`` are the ends of the lists in ``ids``."""
        sizes = self.sizes[ids]
        raw = self.flat[gather(self.starts[ids], sizes)].tobytes()
        edges = [0, *np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()]
        return [raw[a:b] for a, b in zip(edges, edges[1:])]


def decode(encoded: DataFrame, definition: str, *, id_column: str = "doc_id", ids_column: str = "ids",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``decoded`` binary, the bytes of all ids of a row. Null ids give null, no ids empty bytes.

    Characters split over ids are whole again; an id outside the vocabulary is an error. Of the other columns, those in
    ``keep`` stay.
    """
    spark = encoded.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(token_bytes(definition))
    names = [id_column, *keep]
    rows = encoded.select(*names, F.col(ids_column).alias("ids_to_decode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                lists = batch.column(len(names))
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
                valid = lists.is_valid().to_pylist()
                decoded = [d if ok else None for d, ok in zip(decoder(ids, ends), valid)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.binary())],
                                                 names=[*names, "decoded"])

    schema = ", ".join(f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, definition: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text"
               ) -> DataFrame:
    """``encode`` and ``decode`` in one worker: the id, ``ids``, and ``decoded``, the bytes that the ids stand for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # As in ``encode``.
    shared = spark.sparkContext.broadcast({"arguments": (definition, character_classes(tiktoken_joins(pattern)))})
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if "encoder" not in own:
            own["encoder"], own["decoder"] = Encoder(*own["arguments"]), Decoder(token_bytes(own["arguments"][0]))
        for batch in chunks(batches, "text"):
            ids, ends = own["encoder"].ids([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({id_column: batch.column(0), "ids": ragged(ids, ends, pa.int32()),
                                              "decoded": pa.array(own["decoder"](ids, ends), pa.binary())})

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded binary")
