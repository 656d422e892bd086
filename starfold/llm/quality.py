"""Quality by co-training: one classifier reads the text, the other what is known about the page.

Both start from the labels. In each round, each labels the pool rows that it is most sure of for the other, and both
learn again. In the end each view is calibrated on labels that it never saw, and the mean of their log-odds scores all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from starfold.llm.arrow import at_most, bounded_batches, chunks, lengths, received, ship
from starfold.llm.hashing import RangeHash, mix
from starfold.llm.scratch import Scratch
from starfold.llm.words import WordSplitter, shingles, text_bytes

LABELLED_ROWS, POOL_ROWS = 5_000, 2_500
ROUNDS, SURE = 4, 0.95
THRESHOLD = 0.65
TRIGRAMS, LANGUAGES, SOURCES = 1024, 16, 64
_STEPS, _RATE, _DECAY = 200, 0.05, 1e-4


@dataclass
class View:
    """A logistic regression over standardised features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) * self.scale) @ self.weights + self.bias

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(features) + self.shift, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(features: np.ndarray, labels: np.ndarray, decay: float, steps: int) -> tuple[np.ndarray, float]:
    theta, bias = np.zeros(features.shape[1]), 0.0
    first, second = np.zeros(len(theta) + 1), np.zeros(len(theta) + 1)
    for step in range(1, steps + 1):
        error = (labels - _sigmoid(features @ theta.astype(features.dtype) + bias)).astype(features.dtype)
        gradient = np.append(features.T @ error / len(labels) - decay * theta, error.mean())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        move = _RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        theta, bias = theta + move[:-1], bias + move[-1]
    return theta, float(bias)


def learn(features: np.ndarray, labels: np.ndarray) -> View:
    mean, deviation = features.mean(axis=0), features.std(axis=0)
    scale = np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0.0)
    weights, bias = _descend(((features - mean) * scale).astype(np.float32, copy=False), labels, _DECAY, _STEPS)
    return View(mean, scale, weights, bias)


def calibrate(view: View, features: np.ndarray, labels: np.ndarray) -> None:
    """Platt scaling: log-odds are a line over the raw scores. Targets are smoothed, so few labels give mild scores."""
    raw = view.raw(features)
    if len(np.unique(labels)) < 2:
        return
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    spread = raw.std() or 1.0
    slope, shift = _descend((raw / spread)[:, None], target, 0.0, 600)
    view.slope, view.shift = max(float(slope[0]) / spread, 0.0), shift


def co_train(text: np.ndarray, page: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, sure: float = SURE
             ) -> tuple[View, View] | None:
    """Both views from features and labels (1, 0, or -1 for the pool). None where labels are of one kind only."""
    known = np.flatnonzero(labels >= 0)
    held = known[np.arange(len(known)) % 4 == 3]  # for calibration
    start = known[np.arange(len(known)) % 4 != 3]
    if len(np.unique(labels[start])) < 2:
        return None
    pool = np.flatnonzero(labels < 0)
    views, told = [text, page], [dict(zip(start.tolist(), labels[start].tolist())) for _ in range(2)]
    models: list[View] = []
    for turn in range(rounds + 1):
        models = []
        for features, known_to in zip(views, told):
            rows = np.fromiter(known_to, np.int64, len(known_to))
            models.append(learn(features[rows], np.fromiter(known_to.values(), np.float64, len(known_to))))
        if turn == rounds:
            break
        for i, model in enumerate(models):
            other = told[1 - i]
            free = np.array([r for r in pool.tolist() if r not in other], np.int64)
            if not len(free):
                continue
            p = _sigmoid(model.raw(views[i][free]))
            for value, confidence in ((1, p), (0, 1 - p)):
                # In proportion to the labels, so that the shares of good and bad stay.
                most = max(1, int(len(pool) / rounds * (labels[start] == value).mean()))
                best = np.argsort(-confidence, kind="stable")[:most]
                other |= {int(free[r]): value for r in best if confidence[r] >= sure}
    for features, model in zip(views, models):
        calibrate(model, features[held], labels[held].astype(np.float64))
    return models[0], models[1]


def _share(mask: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return (sums[starts + sizes] - sums[starts]) / np.maximum(sizes, 1)


class Features:
    """Features of both views for chunks of documents. One for each task."""

    def __init__(self) -> None:
        self.split, self.range_hash = WordSplitter(), RangeHash()

    def __call__(self, texts: pa.Array, language: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        words = self.split(texts)
        owner = words.owner
        counts = np.diff(words.first)
        raw = words.raw
        starts, sizes = words.text_starts[:-1], np.diff(words.text_starts)
        text_of = np.repeat(np.arange(n), sizes)
        # Text: three bytes at a time, hashed, by square roots of their shares.
        grams = raw[:-2].astype(np.uint64) | raw[1:-1].astype(np.uint64) << np.uint64(8) | \
            raw[2:].astype(np.uint64) << np.uint64(16) if len(raw) > 2 else np.empty(0, np.uint64)
        same = text_of[2:] == text_of[:-2] if len(raw) > 2 else np.empty(0, bool)
        bucket = (mix(grams + np.uint64(1)) & np.uint64(TRIGRAMS - 1)).astype(np.int64)
        cells = np.bincount(text_of[:len(bucket)][same] * TRIGRAMS + bucket[same], minlength=n * TRIGRAMS)
        grams = np.sqrt(cells.reshape(n, TRIGRAMS) / np.maximum(sizes, 1)[:, None])
        word_codes, _ = pd.factorize(mix(words.hashes + mix(owner.astype(np.uint64))))
        of_word = np.bincount(word_codes)
        word_first = np.empty(len(of_word), np.int64)
        word_first[word_codes] = owner
        top = np.zeros(n)
        np.maximum.at(top, word_first, of_word)
        again = np.concatenate([[False], words.hashes[1:] == words.hashes[:-1]]) if len(owner) else np.empty(0, bool)
        runs, run_owner = shingles(words, 5, self.range_hash)
        run_codes, _ = pd.factorize(mix(runs + mix(run_owner.astype(np.uint64))))
        run_count = np.bincount(run_codes) if len(run_codes) else np.empty(0, np.int64)
        repeated = np.bincount(run_owner, run_count[run_codes] > 1, n) / np.maximum(np.bincount(run_owner, minlength=n), 1)
        distinct = np.bincount(word_first, minlength=n) if len(word_first) else np.zeros(n)
        many = np.maximum(counts, 1)
        shape = np.stack([np.log1p(counts), distinct / many, np.log1p(distinct) / np.log1p(many), top / many,
                          np.bincount(owner, again, n) / many, repeated,
                          np.bincount(owner, words.ends - words.starts, n) / many], axis=1)
        text = np.concatenate([grams, shape, shape ** 2], axis=1)
        # Page: language, source, size, lines, and the kinds of characters, as they stand.
        plain, _ = text_bytes(texts)
        letters = ((plain | 32) >= 97) & ((plain | 32) <= 122)
        kinds = [letters & (plain < 97), (plain >= 48) & (plain <= 57), plain >= 128, plain == 10, plain == 32,
                 (plain == 33) | (plain == 63), (plain == 46) | (plain == 44), plain == 124,
                 (plain > 32) & (plain < 128) & ~letters & ~((plain >= 48) & (plain <= 57))]
        plain_sizes = lengths(texts)
        plain_starts = np.cumsum(plain_sizes) - plain_sizes
        shares = np.stack([_share(k, plain_starts, plain_sizes) for k in kinds], axis=1)
        page = np.concatenate([np.log1p(plain_sizes)[:, None], shares, np.sqrt(shares),
                               np.eye(LANGUAGES)[language], np.eye(SOURCES)[source]], axis=1)
        return text, page


def _rows(docs: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    """Id, text, and the hashed language and source; a column that is missing counts as null."""
    bucket = lambda name, n: F.pmod(F.xxhash64(F.col(name) if name in docs.columns else F.lit(None).cast("string")),
                                    F.lit(n)).cast("int")
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                       bucket("lang", LANGUAGES).alias("language"), bucket("source", SOURCES).alias("origin"), *more)


def fit(docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS,
        id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> tuple[View, View] | None:
    """Both views, from at most about ``labelled_rows`` labelled documents and twice ``pool_rows`` others, drawn by a hash of the
    id, and of the text where documents share ids.

    Labels that contradict themselves count as what most rows say, and not at all where they are even. The features of
    the sample meet in one task, which learns: a fixed number for each of a fixed number of rows. Only the weights reach
    the driver.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("labelled"), F.col(label_column).cast("double").alias("y")).dropna()
    known = known.groupBy("labelled").agg(F.avg("y").alias("y")).filter("y <> 0.5")
    rows = _rows(docs, id_column, text_column).filter(F.col("id").isNotNull())
    draw = lambda name, share: F.pmod(F.xxhash64(name, F.lit("quality")), F.lit(1_000_003)) < share * 1_000_003
    chosen = known.filter(draw("labelled", min(1.0, labelled_rows / max(known.count(), 1)))).select(
        "labelled", (F.col("y") > 0.5).cast("int").alias("label"))
    told = rows.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).drop("labelled")
    pool = rows.filter(draw("id", min(1.0, 2 * pool_rows / max(docs.count(), 1)))) \
        .join(known.select("labelled"), F.col("id") == F.col("labelled"), "left_anti").withColumn("label", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in chunks(batches, "text"):
            text, page = features(batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            both = np.concatenate([text, page], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).cast(pa.string()), "label": batch.column(4),
                "text_width": pa.array([text.shape[1]] * len(both), pa.int32()),
                "features": pa.array([row.tobytes() for row in both], pa.binary())})

    # Written first: all tasks of the scan draw, and few tasks go through what was drawn.
    scratch = Scratch(docs.sparkSession, "quality")
    drawn = scratch.write(told.unionByName(pool), "sample")
    bounded = at_most(drawn.filter("label >= 0"), labelled_rows).unionByName(at_most(drawn.filter("label < 0"), 2 * pool_rows))
    sample = bounded.coalesce(8).mapInArrow(run, "id string, label int, text_width int, features binary")
    learned = sample.repartition(1).mapInArrow(_learn, _VIEW).toArrow().to_pylist()
    scratch.drop(drawn)
    if not learned:
        return None
    text, page = sorted(learned, key=lambda view: view["place"])
    return _view(text), _view(page)


_VIEW = "place int, mean array<double>, scale array<double>, weights array<double>, bias double, slope double, shift double"


def _view(row: dict) -> View:
    return View(*(np.array(row[name]) for name in ("mean", "scale", "weights")), row["bias"], row["slope"], row["shift"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both views as rows, from the whole sample; no row where labels are of one kind only."""
    sample = list(batches)
    if not sum(batch.num_rows for batch in sample):
        return
    found = pa.Table.from_batches(sample)
    order = pc.sort_indices(found, [("id", "ascending"), ("features", "ascending")]).to_numpy()
    order = order[np.random.default_rng(0).permutation(found.num_rows)]
    width, labels = found["text_width"][0].as_py(), found["label"].to_numpy()[order]
    column = found["features"].combine_chunks()
    del sample, found
    size = len(column[0].as_py()) // 4
    both = np.frombuffer(column.buffers()[2], np.float32, len(column) * size).reshape(-1, size)[order]
    del column
    views = co_train(both[:, :width], both[:, width:], labels)
    for place, view in enumerate(views or ()):
        yield pa.RecordBatch.from_pydict({
            "place": pa.array([place], pa.int32()),
            **{name: pa.array([getattr(view, name).tolist()], pa.list_(pa.float64())) for name in ("mean", "scale", "weights")},
            **{name: pa.array([float(getattr(view, name))], pa.float64()) for name in ("bias", "slope", "shift")}})


def score(docs: DataFrame, views: tuple[View, View] | None, *, threshold: float = THRESHOLD, id_column: str = "doc_id",
          text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, ``text_score`` and ``page_score`` of the two views, ``score`` of both (0 to 1,
    higher is better) and ``good`` (1 from ``threshold`` on).

    Without views, as where labels are of one kind only, all scores are 0.5 and all documents are good. A null text counts as
    empty, a missing language or source as null. Null ids and repeated rows come back as they are, and an empty table
    gives an empty result. Of the other columns, those in ``keep`` stay.
    """
    bounded_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, views)  # a fixed number of weights
    rows = _rows(docs, id_column, text_column, *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, models = Features(), received(shared)
        for batch in chunks(batches, "text"):
            odds = [np.zeros(batch.num_rows)] * 2
            if models:
                both = features(batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                odds = [model.log_odds(x) for model, x in zip(models, both)]
            columns = [batch.column(0), *(pa.array(_sigmoid(o), pa.float64()) for o in (*odds, (odds[0] + odds[1]) / 2))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[4:]],
                                             names=["id", "text_score", "page_score", "score", *batch.schema.names[4:]])

    kind = docs.schema[id_column].dataType.simpleString()
    more = "".join(f", kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    scored = rows.mapInArrow(run, f"id {kind}, text_score double, page_score double, score double{more}")
    return scored.select(F.col("id").alias(id_column), "text_score", "page_score", "score",
                         (F.col("score") >= threshold if views else F.lit(True)).cast("int").alias("good"),
                         *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])
