"""Benchmark decontamination by latent semantic retrieval.

1. Each document is reduced to the places of the words that the benchmark has too.
2. Passages of the corpus, weighted by TF-IDF, are sketched in one distributed pass, C = A'(A G) with a random G; from C and
   G come the leading right singular vectors of A (Nystroem).
3. Windows of every document, of several lengths, are compared with the benchmark's items in that latent space.
4. Candidates are checked word by word: longest common subsequence, and whether the end of the item, its answer, is there.

Items that a document holds word for word are also searched as they are, by their rarest pair of words, so that they are
found however frequent their words are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starfold.llm.arrow import bounded_batches, chunks, gather, received, ship
from starfold.llm.scratch import Scratch
from starfold.llm.substring import common_subsequence, document_key
from starfold.llm.words import WordSplitter

ITEMS_AT_ONCE = 10_000
PASSAGE_WORDS = 64
COMPONENTS, OVERSAMPLING = 64, 8
COLUMNS = 1 << 15
COSINE, EXACT_COSINE = 0.45, 0.3
LEAST_IDF = 0.1  # of words that are in nearly all passages
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.5
_SCALES = (3, 6, 12, 24, 48)
_LINE = 1 << 32
_BROADCAST_ROWS = 200_000


@dataclass
class Item:
    number: int  # its place in the block
    words: np.ndarray  # numbers in the vocabulary
    answer: np.ndarray


class Block:
    """A bounded number of benchmark items: the vocabulary, and each item's words as numbers in it."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids = ids
        words = WordSplitter()(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(words.hashes)
        numbers = np.searchsorted(self.vocabulary, words.hashes)
        answers = WordSplitter()(pa.array([_answer(t) for t in texts], pa.string()))
        answer_numbers = np.searchsorted(self.vocabulary, answers.hashes)
        part = lambda values, w, i: values[w.first[i]:w.first[i + 1]]
        self.items = [Item(i, part(numbers, words, i), part(answer_numbers, answers, i)) for i in range(len(texts))]
        self.items = [item for item in self.items if len(item.words)]

    def pieces(self) -> list[tuple[int, np.ndarray]]:
        """Items cut into pieces of at most a passage, so that long ones are found by their parts."""
        return [(at, part) for at, item in enumerate(self.items)
                for part in np.array_split(item.words, math.ceil(len(item.words) / PASSAGE_WORDS))]


def _answer(text: str) -> str:
    """The end of an item: what follows a last ``Answer:``, else its last sentence."""
    marked = re.split(r"(?i)\banswer\s*:", text)
    if len(marked) > 1 and marked[-1].strip():
        return marked[-1]
    parts = [p for p in re.split(r"[.!?\n]+", text) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


def _postings(docs: DataFrame, block: Block, id_column: str, text_column: str) -> DataFrame:
    """``key``, ``id``, ``pos`` and ``word``: places of the words in the vocabulary, as int32 bytes. Documents that have
    none are left out, as nothing of the benchmark can be in them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(block.vocabulary)
    rows = docs.select(document_key(docs, id_column, text_column).alias("key"), F.col(id_column).alias("id"),
                       F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = shared.value, WordSplitter()
        bits = max(16, int(len(vocabulary)).bit_length() + 4)
        mask = np.uint64((1 << bits) - 1)
        maybe = np.zeros(1 << bits, bool)
        maybe[(vocabulary & mask).astype(np.int64)] = True
        for batch in chunks(batches, "text"):
            words = split(batch.column(2))
            likely = np.flatnonzero(maybe[(words.hashes & mask).astype(np.int64)])
            hashes = words.hashes[likely]
            number = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[number] == hashes
            likely, number = likely[known], number[known].astype(np.int32)
            edges = np.searchsorted(likely, words.first)
            pos = (likely - np.repeat(words.first[:-1], np.diff(edges))).astype(np.int32)
            some = np.flatnonzero(np.diff(edges))
            cut = lambda values: pa.array([values[edges[i]:edges[i + 1]].tobytes() for i in some], pa.binary())
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), cut(pos), cut(number)],
                                             names=["key", "id", "pos", "word"])

    return rows.mapInArrow(run, f"key long, id {docs.schema[id_column].dataType.simpleString()}, pos binary, word binary")


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, place and word number of all places of a batch."""
    places, words = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pos", "word"))
    owner = np.repeat(np.arange(len(places)), [len(p) // 4 for p in places])
    return owner, np.frombuffer(b"".join(places), np.int32), np.frombuffer(b"".join(words), np.int32)


def _passages(owner: np.ndarray, pos: np.ndarray, word: np.ndarray, n_words: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, word and count of each distinct word of a passage, and how many passages there are."""
    passage = owner.astype(np.int64) * _LINE + pos // PASSAGE_WORDS
    new = np.concatenate([[True], passage[1:] != passage[:-1]]) if len(passage) else np.empty(0, bool)
    passage = np.cumsum(new) - 1
    codes, _ = pd.factorize(passage * n_words + word)
    count = np.bincount(codes)
    first = np.empty(len(count), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return passage[first], word[first], count, int(new.sum())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _document_frequencies(postings: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each word is, and how many passages hold any. One array for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(n_words, np.int64), 0
        for batch in _slices(batches):
            _, word, _, n = _passages(*_joined(batch), n_words)
            found += np.bincount(word, minlength=n_words)
            total += n
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(some, -1), pa.int32()),
                                          "n": pa.array(np.append(found[some], total), pa.int64())})

    # As many rows as the vocabulary has words reach the driver.
    rows = postings.select("pos", "word").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).toArrow()
    word, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    found = np.zeros(n_words, np.int64)
    found[word[word >= 0]] = n[word >= 0]
    return found, int(n[word < 0].sum())


def _weights(word: np.ndarray, count: np.ndarray, passage: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    weight = (1 + np.log(count)) * idf[word]
    norm = np.sqrt(np.bincount(passage, weight ** 2, n))
    return weight / np.maximum(norm, 1e-12)[passage]


def _sketch(postings: DataFrame, idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'(A G) over all passages of the corpus, for the test matrix G: a sum of one small matrix for each task."""
    n_columns, width = test.shape
    shared = postings.sparkSession.sparkContext.broadcast((idf, test))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, test = shared.value
        found = np.zeros(test.shape)
        test = test.astype(np.float32)
        for batch in _slices(batches):
            owner, pos, word = _joined(batch)
            passage, word, count, n = _passages(owner, pos, word, len(idf))
            if not n:
                continue
            weight = _weights(word, count, passage, idf, n).astype(np.float32)[:, None]
            column = word % len(test)
            product = np.add.reduceat(test[column] * weight, np.flatnonzero(np.diff(passage, prepend=-1)), axis=0)
            order = np.argsort(column, kind="stable")
            start = np.flatnonzero(np.diff(column[order], prepend=-1))
            found[column[order][start]] += np.add.reduceat(product[passage[order]] * weight[order], start, axis=0)
        some = np.flatnonzero(found.any(axis=1))
        yield pa.RecordBatch.from_pydict({
            "col": pa.array(some, pa.int32()),
            "sums": pa.array(list(found[some]), pa.list_(pa.float64()))})

    rows = postings.select("pos", "word").mapInArrow(run, "col int, sums array<double>")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    table = rows.groupBy("col").agg(*sums).toArrow()  # at most COLUMNS rows
    found = np.zeros((n_columns, width))
    if table.num_rows:
        found[table.column(0).to_numpy()] = np.stack([c.to_numpy() for c in table.columns[1:]], axis=1)
    return found


def latent_space(sketch: np.ndarray, test: np.ndarray, components: int) -> np.ndarray:
    """The leading right singular vectors of A over their singular values, columns x components, from C = A'A G (randomised
    Nystroem method). Without the division, the few strongest directions would make all passages alike."""
    shift = 1e-8 * max(np.linalg.norm(sketch), 1e-12)
    shifted = sketch + shift * test
    core = test.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, 1e-12 * max(values.max(initial=0), 1e-12)))
    left, singular, _ = np.linalg.svd(shifted @ half, full_matrices=False)
    kept = singular[:components] > 1e-6 * max(singular.max(initial=0), 1e-12)
    return left[:, :components][:, kept] / singular[:components][kept]


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _check(item: Item, pos: np.ndarray, word: np.ndarray) -> tuple[float, float, int]:
    """Share of the item's words, and of its answer's, that are in order at the best place, and that place."""
    n = len(item.words)
    i, j = np.nonzero(item.words[:, None] == word[None, :])
    if len(i) < 0.4 * n:
        return 0.0, 0.0, 0
    start = pos[j] - i
    low = start.min()
    near = np.bincount(start - low)
    slack = max(2, n // 8)
    at = int(np.convolve(near, np.ones(2 * slack + 1, int), "same").argmax()) + low
    inside = word[(pos >= at - slack) & (pos < at + n + 2 * slack)].tolist()
    share = common_subsequence(item.words.tolist(), inside) / n
    answer = common_subsequence(item.answer.tolist(), inside) / len(item.answer) if len(item.answer) else 1.0
    return share, answer, int(at)


def _pair(one: np.ndarray, two: np.ndarray, n_words: int) -> int:
    """A number of two words beside one another, below 0 for a single word."""
    return int(one[0]) * n_words + int(two[0]) if len(two) else int(one[0]) - n_words


class Finder:
    """Finds the items of a block in documents' postings. One for each task."""

    def __init__(self, block: Block, idf: np.ndarray, space: np.ndarray, cosine: float) -> None:
        self.block, self.idf, self.cosine = block, idf, cosine
        self.latent = (space[np.arange(len(idf)) % len(space)] * idf[:, None]).astype(np.float32)  # of each word
        self.pieces = block.pieces()
        self.vectors = _units(np.stack([self.latent[words].sum(axis=0) for _, words in self.pieces]))
        sizes = np.array([len(words) for _, words in self.pieces])
        self.scales = np.array(_SCALES)[np.maximum(np.searchsorted(_SCALES, sizes, "right") - 1, 0)]
        self.step = max(int(self.scales.min()) // 2, 1)
        # Each item's rarest pair of words that follow one another, or its word if it has but one.
        rarest = [int((idf[x.words[:-1]] + idf[x.words[1:]]).argmax()) if len(x.words) > 1 else 0 for x in block.items]
        anchors = np.array([_pair(x.words[i:i + 1], x.words[i + 1:i + 2], len(idf)) for i, x in zip(rarest, block.items)])
        self.order = np.argsort(anchors, kind="stable")
        self.anchors, self.rarest = anchors[self.order], np.array(rarest)[self.order]
        self.answers = [common_subsequence(x.answer.tolist(), x.words.tolist()) / max(len(x.answer), 1) if len(x.answer)
                        else 1.0 for x in block.items]

    def __call__(self, owner: np.ndarray, pos: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """Document, item, place, share and answer's share of each find."""
        if not len(pos):
            return []
        line = owner.astype(np.int64) * _LINE + pos
        hits = self._candidates(line, word)
        # Windows of one item that lie next to one another are one candidate.
        hits = hits[np.lexsort((hits[:, 0], hits[:, 1]))]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, 1] != hits[:-1, 1]) | (hits[1:, 0] - hits[:-1, 0] > PASSAGE_WORDS)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(hits)) - 1
        rows = []
        for s, e in zip(start.tolist(), end.tolist()):
            item = self.block.items[hits[s, 1]]
            reach = 2 * len(item.words) + PASSAGE_WORDS
            document, first = divmod(int(hits[s, 0]), _LINE)
            base, last = document * _LINE, int(hits[e, 0] + hits[e, 2])
            a, b = np.searchsorted(line, [base + max(first - reach, 0), min(last + reach, base + _LINE - 1)])
            share, answer, at = _check(item, pos[a:b], word[a:b])
            if share >= SURE or share >= LIKELY and answer >= ANSWER:
                rows.append((document, item.number, max(at, 0), share, answer))
        return rows + self._verbatim(line, word)

    def _verbatim(self, line: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """The first place of each item that a document holds word for word."""
        n = len(self.idf)
        places = [np.arange(len(word))]
        codes = [word.astype(np.int64) - n]  # of single words
        beside = np.flatnonzero(np.diff(line) == 1)
        places.append(beside)
        codes.append(word[beside].astype(np.int64) * n + word[beside + 1])
        found = {}
        for place, code in zip(places, codes):
            low, high = np.searchsorted(self.anchors, code), np.searchsorted(self.anchors, code, "right")
            some = np.flatnonzero(high > low)
            sizes = (high - low)[some]
            at = gather(low[some], sizes)
            starts, numbers = np.repeat(place[some], sizes) - self.rarest[at], self.order[at]
            by_item = np.argsort(numbers, kind="stable")
            edges = np.flatnonzero(np.diff(numbers[by_item], prepend=-1, append=-1))
            for s, e in zip(edges, edges[1:]):
                number = int(numbers[by_item[s]])
                item, first = self.block.items[number], np.sort(starts[by_item[s:e]])
                size = len(item.words)
                first = first[(first >= 0) & (first + size <= len(word))]
                first = first[line[first + size - 1] - line[first] == size - 1]
                for i, x in enumerate(item.words.tolist()):
                    if not len(first):
                        break
                    first = first[word[first + i] == x]
                documents, index = np.unique(line[first] // _LINE, return_index=True)
                for document, i in zip(documents.tolist(), index.tolist()):
                    found[document, number] = (document, item.number, int(line[first[i]] % _LINE), 1.0, self.answers[number])
        return list(found.values())

    def _candidates(self, line: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Start of the window, item and length of window, where latent and then exact cosine are high enough."""
        # Sums of the latent vectors over steps, which all windows are made of.
        step_of = line // _LINE * _LINE + line % _LINE // self.step
        first = np.flatnonzero(np.diff(step_of, prepend=-1))
        steps = step_of[first]
        sums = np.concatenate([np.add.reduceat(self.latent[word[x:y]], first[i:j] - x, axis=0)
                               for i, j, x, y in _cuts(first, len(word))])
        sums = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
        counts = np.append(first, len(word))
        found = [np.empty((0, 3), np.int64)]
        for scale in np.unique(self.scales).tolist():
            mine = np.flatnonzero(self.scales == scale)
            wide, stride = max(scale // self.step, 1), max(scale // 2 // self.step, 1)
            document, place = steps // _LINE, steps % _LINE
            begin = np.unique(np.concatenate([document * _LINE + np.maximum(place // stride - d, 0) * stride for d in (0, 1)]))
            low, high = np.searchsorted(steps, begin), np.searchsorted(steps, begin + wide)
            full = counts[high] - counts[low] >= max(scale // 2, 1)
            begin, low, high = begin[full], low[full], high[full]
            for at in range(0, len(begin), 8192):
                part = slice(at, at + 8192)
                windows = _units(sums[high[part]] - sums[low[part]]).astype(np.float32)
                w, i = np.nonzero(windows @ self.vectors[mine].T >= self.cosine)
                if len(w):
                    keep = self._exact(word, counts[low[part]][w], counts[high[part]][w], mine[i])
                    w, i = w[keep], i[keep]
                    places = begin[part][w]
                    places = places // _LINE * _LINE + places % _LINE * self.step
                    items = np.array([self.pieces[x][0] for x in mine[i].tolist()], np.int64)
                    found.append(np.stack([places, items, np.full(len(w), scale)], axis=1))
        return np.concatenate(found)

    def _exact(self, word: np.ndarray, low: np.ndarray, high: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the TF-IDF cosine of window and item, over the words themselves, is high enough too."""
        keep = np.zeros(len(piece), bool)
        order = np.argsort(piece, kind="stable")
        edges = np.flatnonzero(np.diff(piece[order], prepend=-1, append=-1))
        square = self.idf ** 2
        for s, e in zip(edges, edges[1:]):
            rows = order[s:e]
            own = np.unique(self.pieces[piece[rows[0]]][1])
            weight = np.zeros(len(square))
            weight[own] = square[own]
            sizes = high[rows] - low[rows]
            inside = word[gather(low[rows], sizes)]
            at = np.cumsum(sizes) - sizes
            shared, norm = np.add.reduceat(weight[inside], at), np.add.reduceat(square[inside], at)
            keep[rows] = shared >= EXACT_COSINE * np.sqrt(np.maximum(norm, 1e-12) * weight.sum())
        return keep


def _cuts(first: np.ndarray, n: int, size: int = 4096) -> Iterator[tuple[int, int, int, int]]:
    """Runs of steps, and the words that they hold."""
    for i in range(0, len(first), size):
        j = min(i + size, len(first))
        yield i, j, int(first[i]), int(first[j]) if j < len(first) else n


def _search(postings: DataFrame, block: Block, idf: np.ndarray, space: np.ndarray, cosine: float) -> DataFrame:
    shared = ship(postings.sparkSession, (block, idf, space))
    kind = postings.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*received(shared), cosine)
        for batch in _slices(batches):
            rows = finder(*_joined(batch))
            if rows:
                document, number, at, share, answer = zip(*rows)
                take = pa.array(document)
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).take(take), "id": batch.column(1).take(take),
                    "item": pa.array(number, pa.int32()), "start_word": pa.array(at, pa.int32()),
                    "share": pa.array(share, pa.float64()), "answer_share": pa.array(answer, pa.float64())})

    return postings.mapInArrow(run, f"key long, id {kind}, item int, start_word int, share double, answer_share double")


def leaks(docs: DataFrame, benchmark: DataFrame, *, components: int = COMPONENTS, cosine: float = COSINE,
          items_at_once: int = ITEMS_AT_ONCE, id_column: str = "doc_id", text_column: str = "text",
          item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds, word for word or paraphrased: ``key`` (of id and text),
    the id, the item's id, ``start_word``, ``share`` (of the item's words, in order) and ``answer_share``.

    A benchmark of any size is taken in blocks of ``items_at_once`` items, and the documents are gone through for each;
    only a block's items reach the driver. Items and documents that are null, empty or without words match nothing. Null
    ids stay null, rows that repeat id and text give one result, equal items one each. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = benchmark.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).dropna(subset=["text"]).distinct()
    blocks = max(1, math.ceil(items.count() / items_at_once))
    parts = []
    for number in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).orderBy("item", "text").toArrow()
        block = Block(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        if not block.items:
            continue
        postings = scratch.write(_postings(docs, block, id_column, text_column), "postings")
        n_words = len(block.vocabulary)
        frequency, n = _document_frequencies(postings, n_words)
        idf = np.log((n + 1) / (frequency + 0.5)).clip(LEAST_IDF)
        test = np.random.default_rng(0).standard_normal((min(n_words, COLUMNS), components + OVERSAMPLING))
        space = latent_space(_sketch(postings, idf, test), test, components)
        found = scratch.write(_search(postings, block, idf, space, cosine), "found")
        scratch.drop(postings)
        ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.ids)), pa.int32()),
                                              "item_id": rows.column(0)}))
        best = found.groupBy("key", "id", "item").agg(
            F.max(F.struct("share", "answer_share", (-F.col("start_word")).alias("at"))).alias("best"))
        parts.append(best.join(F.broadcast(ids), "item").select(
            "key", F.col("id").alias(id_column), F.col("item_id").alias(item_column), (-F.col("best.at")).alias("start_word"),
            "best.share", "best.answer_share"))
    if not parts:
        kinds = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
        return spark.createDataFrame([], f"key long, `{id_column}` {kinds[0]}, `{item_column}` {kinds[1]}, start_word int, "
                                         "share double, answer_share double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. ``options`` are those of ``leaks``."""
    scratch = Scratch(docs.sparkSession, "decontam-rows")
    key = document_key(docs, options.get("id_column", "doc_id"), options.get("text_column", "text"))
    found = scratch.write(leaks(docs, benchmark, **options).select(F.col("key").alias("leak_key")).distinct(), "keys")
    if found.count() <= _BROADCAST_ROWS:  # else both sides are shuffled
        found = F.broadcast(found)
    return docs.join(found, key == F.col("leak_key"), "left_anti")
