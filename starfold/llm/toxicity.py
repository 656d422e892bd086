"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence has the probability s = sigmoid(bias + sum of the weights of its distinct features), and a document is toxic if any
sentence is: 1 - product of (1 - s), the noisy-or. Training on labels of documents finds the words that make a sentence
toxic; the sentence scores then say where a document offends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starfold.llm.arrow import at_most, bounded_batches, chunks, ragged
from starfold.llm.hashing import mix
from starfold.llm.scratch import Scratch
from starfold.llm.words import WordSplitter

SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18
THRESHOLD = 0.7
_ROUNDS, _RATE = 400, 0.1
_PREFIXES = (4, 5, 6)  # bytes
_CLEAR = 3.0  # standard deviations
_SUPPORT = 0.3  # the penalty, in documents: what speaks for fewer gets no weight
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentences(texts: pa.Array, split: WordSplitter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each distinct feature of a sentence, its sentence, and of each sentence its text and last word.

    Features are words and the first letters of longer ones, so that inflected forms share some. Sentences end at a full
    stop, exclamation or question mark, or line break; only those with words count. The last is given as its number among
    the words of the text.
    """
    words = split(texts)
    ends = np.cumsum(_END[words.raw]) if len(words.raw) else np.zeros(1, np.int64)
    owner = words.owner
    before = ends[words.starts] if len(words.starts) else np.empty(0, np.int64)
    new = np.ones(len(owner), bool)
    new[1:] = (before[1:] != before[:-1]) | (owner[1:] != owner[:-1])
    sentence = np.cumsum(new) - 1
    parts, owners = [words.hashes], [sentence]
    sizes = words.ends - words.starts
    for n in _PREFIXES:
        longer = np.flatnonzero(sizes > n)
        starts = words.starts[longer]
        parts.append(mix(split.range_hash(split.values(words.raw), starts, starts + n) + np.uint64(n)))
        owners.append(sentence[longer])
    bucket = (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64)
    # Distinct features in order of the sentences.
    pairs = np.concatenate(owners) * BUCKETS + bucket
    distinct = np.sort(pd.unique(pairs))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner))[:len(at)] - 1
    return distinct % BUCKETS, distinct // BUCKETS, owner[at], last - words.first[owner[at]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sentence_scores(weights: np.ndarray, bias: float, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return _sigmoid(bias + np.bincount(sentence, weights[bucket], n))


def noisy_or(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(scores, 1 - 1e-12)), n))


def train(bucket: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int = _ROUNDS
          ) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias, by proximal gradient steps (Adam) on the penalised log-likelihood of the labels."""
    n, n_sentences = len(labels), len(owner)
    weights, bias = np.zeros(BUCKETS), -4.0
    if not n or not n_sentences:
        return weights, bias
    used, column = np.unique(bucket, return_inverse=True)
    theta = np.zeros(len(used) + 1)
    theta[-1] = bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        s = _sigmoid(theta[-1] + np.bincount(sentence, theta[:-1][column], n_sentences))
        p = np.clip(noisy_or(s, owner, n), 1e-9, 1 - 1e-9)
        # d log-likelihood / d logit of a sentence: s (y (1 - p) / p - (1 - y))
        slope = s * np.where(labels[owner] == 1, (1 - p[owner]) / p[owner], -1.0)
        gradient = np.append(np.bincount(column, slope[sentence], len(used)), slope.sum()) / n
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        pace = _RATE / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        theta += pace * first / (1 - 0.9 ** step)
        # The penalty on the words' absolute weights, as a step of its own: most weights become zero.
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - pace[:-1] * _SUPPORT / n, 0)
    weights[used] = theta[:-1]
    return weights, float(theta[-1])


def held_out(id_column: str) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_column: str, text_column: str
                    ) -> DataFrame:
    """At most about ``rows`` labelled documents, ``text`` and ``label``, drawn by a hash of the id, and
    of the text where documents share ids.

    A label that contradicts itself counts as what most rows say, and none where they are even. Documents that share an
    id share its label.
    """
    known = labels.select(F.col(id_column).alias("labelled"), F.col(label).cast("double").alias("y")).dropna()
    known = known.groupBy("labelled").agg(F.avg("y").alias("y")).filter("y <> 0.5")
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    draw = (F.pmod(F.xxhash64("labelled"), F.lit(1_000_003)) < share * 1_000_003)
    chosen = known.filter(draw).select("labelled", (F.col("y") > 0.5).cast("int").alias("label"))
    drawn = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(
        F.broadcast(chosen), F.col("id") == F.col("labelled")).select("id", "text", "label")
    return at_most(drawn, rows)


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, id_column: str = "doc_id",
        text_column: str = "text", label_column: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias from at most about ``rows`` labelled documents.

    Features are screened first: only those that are clearly more frequent in documents labelled 1 can carry their
    sentences' weight, and only they reach the driver. Without both labels nothing is learned, and all scores are low.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(labelled_sample(docs, labels, label_column, rows, id_column, text_column), "sample")
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        return np.zeros(BUCKETS), -8.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, marked = WordSplitter(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches, "text"):
            bucket, sentence, owner, _ = sentences(batch.column(1), split)
            pairs = pd.unique(bucket * batch.num_rows + owner[sentence])
            seen += np.bincount(pairs // batch.num_rows, minlength=BUCKETS)
            ones = pairs[batch.column(2).to_numpy()[pairs % batch.num_rows] == 1]
            marked += np.bincount(ones // batch.num_rows, minlength=BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "seen": seen[some], "marked": marked[some]})

    share = ones / n
    counted = sample.mapInArrow(count, "bucket int, seen long, marked long").groupBy("bucket").agg(
        F.sum("seen").alias("seen"), F.sum("marked").alias("marked"))
    clear = counted.filter((F.col("seen") >= 3) & (F.col("marked") - F.col("seen") * share >= _CLEAR * F.sqrt(
        F.col("seen") * (share * (1 - share)))))
    kept = np.zeros(BUCKETS, bool)
    kept[clear.select("bucket").toArrow().column(0).to_numpy()] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = WordSplitter()
        for batch in chunks(batches, "text"):
            n = batch.num_rows
            bucket, sentence, owner, _ = sentences(batch.column(1), split)
            keep = kept[bucket]
            bucket, sentence = bucket[keep], sentence[keep]
            first = np.searchsorted(owner, np.arange(n + 1))
            of_text = owner[sentence]
            ends = np.searchsorted(of_text, np.arange(1, n + 1))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).cast(pa.string()), "label": batch.column(2), "n": pa.array(np.diff(first), pa.int32()),
                "buckets": ragged(bucket, ends, pa.int32()), "sentences": ragged(sentence - first[of_text], ends, pa.int32())})

    found = sample.mapInArrow(features, "id string, label int, n int, buckets array<int>, sentences array<int>").toArrow()
    found = found.sort_by([("id", "ascending"), ("n", "ascending")]).combine_chunks()  # sums do not depend on the tasks
    scratch.drop(sample)
    n_sentences = found["n"].to_numpy().astype(np.int64)
    lists = found["sentences"].combine_chunks()
    shift = np.repeat(np.cumsum(n_sentences) - n_sentences, lists.value_lengths().to_numpy())
    return train(found["buckets"].combine_chunks().flatten().to_numpy().astype(np.int64),
                 lists.flatten().to_numpy().astype(np.int64) + shift, np.repeat(np.arange(len(n_sentences)), n_sentences),
                 found["label"].to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, threshold: float = THRESHOLD, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``score`` from 0 to 1, ``predicted`` (1 from ``threshold`` on), and the worst
    sentence: ``worst_score``, and its place ``worst_start``, ``worst_end`` in words of the text (null without words).

    Null and empty texts score 0. Null ids and repeated rows come back as they are; an empty table gives an empty
    result; other columns are left out. Whole texts are scored, of any length.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        split = WordSplitter()
        for batch in chunks(batches, "text"):
            n = batch.num_rows
            bucket, sentence, owner, last = sentences(batch.column(1), split)
            scores = sentence_scores(weights, bias, bucket, sentence, len(owner))
            total = np.clip(noisy_or(scores, owner, n), 0, 1)
            order = np.lexsort((-np.arange(len(owner)), scores, owner))
            top = np.searchsorted(owner, np.arange(n), "right") - 1
            some = np.bincount(owner, minlength=n) > 0
            worst = order[np.maximum(top, 0)] if len(order) else np.zeros(n, np.int64)
            start = np.zeros(len(owner), np.int64)
            start[1:] = np.where(owner[1:] == owner[:-1], last[:-1] + 1, 0)
            pick = lambda values, kind: pa.array(
                values[worst] if len(values) else np.zeros(n, values.dtype), kind, mask=~some)
            yield pa.RecordBatch.from_pydict({
                id_column: batch.column(0), "score": pa.array(total, pa.float64()),
                "worst_score": pick(scores, pa.float64()), "worst_start": pick(start, pa.int32()),
                "worst_end": pick(last + 1, pa.int32())})

    kind = docs.schema[id_column].dataType.simpleString()
    scored = rows.mapInArrow(run, f"`{id_column}` {kind}, score double, worst_score double, worst_start int, worst_end int")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
