"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's logit is a bias and the sum of its words' weights, a word's weight the sum of
hashed features: the word and its beginnings, so that inflected forms of a learnt word
count.  Sentence probabilities are combined by noisy-or, and its likelihood over document
labels is what training maximises; sentences have no labels of their own.  The sentences
that make a document toxic are then those with high probability.

The model is fitted on at most ``MAX_TRAIN`` labelled documents, those with the least hash
of their id, in one task; it has a fixed size.  Scoring reads every text whole.

Texts without words, empty and NULL ones score 0.  Labels that are NULL or whose document
is missing are not used; of several labels of a document the largest counts.  Without any
usable label every text scores the same prior.  Equal texts score equally.  Columns named
like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.llm.common import (
    LOWER,
    MARK_BYTES,
    Shared,
    byte_values,
    hash_spans,
    letters_in,
    mix,
    pieces,
    spans,
    utf8,
    with_columns,
)

#: Labelled documents that the model is fitted on, at most.
MAX_TRAIN = 12_000
#: Hashed feature weights; number 0 is no feature.
WEIGHTS = 1 << 18
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
ROUNDS, RATE, DECAY, PRIOR = 80, 0.25, 0.1, -6.0
#: A feature needs so many toxic documents, and to be so many times as frequent in them.
LEAST_SEEN, LEAST_LIFT = 5, 4
#: A sentence is named as offending from this probability.
OFFENDING = 0.5

_LETTERS, _VALUES = letters_in(MARK_BYTES), byte_values()
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n\r")] = True
_LOWER = np.frombuffer(LOWER, np.uint8)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters of Latin-1."""
    data = _LOWER[data]
    place = np.flatnonzero(data[:-1] == 0xC3) + 1
    place = place[(data[place] >= 0x80) & (data[place] <= 0x9E) & (data[place] != 0x97)]
    data[place] += 0x20
    return data


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of feature numbers per word."""
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.int32)
    for column, length in enumerate((0, *BEGINNINGS)):
        chosen = ends - starts >= length
        stop = starts[chosen] + length if length else ends
        hashes = mix(hash_spans(data, starts[chosen], stop, _VALUES) + np.uint64(length))
        out[chosen, column] = 1 + (hashes % np.uint64(WEIGHTS - 1)).astype(np.int32)
    return out


@dataclass
class Bags:
    """Words of sentences of rows: distinct words by feature numbers, and where they stand."""

    keys: np.ndarray  # hashes of the distinct words
    features: np.ndarray  # distinct words x features
    word: np.ndarray  # sentence by sentence, its words
    sentence: np.ndarray  # where each sentence begins in them
    row: np.ndarray  # of each sentence
    spans: tuple[np.ndarray, np.ndarray]  # bytes of each sentence

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Bags:
        starts, ends, rows = spans(data, offsets, _LETTERS)
        if not len(starts):
            none = np.empty(0, np.int64)
            table = np.empty((0, 1 + len(BEGINNINGS)), np.int32)
            return Bags(np.empty(0, np.uint64), table, none, none, none, (none, none))
        data = fold(data)
        word, known = pd.factorize(hash_spans(data, starts, ends, _VALUES))
        first = np.empty(word.max() + 1, np.int64)
        first[word[::-1]] = np.arange(len(word))[::-1]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
        stops = np.cumsum(_ENDS[data])[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (stops[1:] != stops[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        last = np.concatenate([begin[1:], [len(starts)]]) - 1
        table = features(data, starts[first], ends[first])
        # A word counts once in a sentence.
        pairs = np.sort((np.cumsum(new) - 1) * len(known) + word)
        sentence, word = np.divmod(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])], len(known))
        sentence = np.searchsorted(sentence, np.arange(len(begin)))
        return Bags(known, table, word.astype(np.int32), sentence, owner[begin], (starts[begin], ends[last]))

    @staticmethod
    def of_rows(texts: pa.ChunkedArray) -> Bags:
        """Those of many rows, read in pieces so that only words and sentences are held; no spans."""
        parts, first, rows = [], [], 0
        for piece in pieces(pa.table([texts], ["text"]).to_batches(), "text"):
            parts.append(Bags.of(*utf8(piece.column("text"))))
            first.append(rows)
            rows += piece.num_rows
        if not parts:
            return Bags.of(np.empty(0, np.uint8), np.zeros(1, np.int64))
        number, known = pd.factorize(np.concatenate([p.keys for p in parts]))
        table = np.empty((len(known), 1 + len(BEGINNINGS)), np.int32)
        table[number] = np.concatenate([p.features for p in parts])
        edges = np.cumsum([0] + [len(p.keys) for p in parts])
        word = [number[e : e + len(p.keys)][p.word].astype(np.int32) for e, p in zip(edges, parts)]
        starts = np.cumsum([0] + [len(p.word) for p in parts])
        sentence = np.concatenate([p.sentence + s for s, p in zip(starts, parts)])
        row = np.concatenate([p.row + f for f, p in zip(first, parts)])
        return Bags(known, table, np.concatenate(word), sentence, row, (sentence, sentence))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, bags: Bags) -> np.ndarray:
        """Of each sentence."""
        if not len(bags.sentence):
            return np.empty(0)
        words = self.weights[bags.features].sum(axis=1)
        return self.bias + np.add.reduceat(words[bags.word], bags.sentence)


def noisy_or(logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """log(1 - p) of each row: no sentence is toxic."""
    return -np.bincount(row, np.logaddexp(0, logits), rows)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers.sort()
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])]


def evidence(bags: Bags, labels: np.ndarray) -> np.ndarray:
    """Features that enough toxic documents have, and toxic ones far more often than others."""
    owner = np.repeat(bags.row.astype(np.int32), np.diff(np.concatenate([bags.sentence, [len(bags.word)]])))
    toxic, clean = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    pairs = _distinct(owner * np.int64(len(bags.features)) + bags.word)
    owner, word = (x.astype(np.int32) for x in np.divmod(pairs, len(bags.features)))
    del pairs
    for column in bags.features.T:
        row, feature = np.divmod(_distinct(owner * np.int64(WEIGHTS) + column[word]), WEIGHTS)
        toxic += np.bincount(feature, labels[row] > 0, WEIGHTS)
        clean += np.bincount(feature, labels[row] <= 0, WEIGHTS)
    rate = (toxic + 0.5) / (np.sum(labels > 0) + 1)
    chosen = (toxic >= LEAST_SEEN) & (rate > LEAST_LIFT * (clean + 0.5) / (np.sum(labels <= 0) + 1))
    chosen[0] = False
    return chosen


def train(bags: Bags, labels: np.ndarray) -> Model:
    """Adagrad on the noisy-or likelihood of the documents' labels, weights not below zero."""
    model, rows = Model(np.zeros(WEIGHTS), PRIOR), len(labels)
    if not rows or not len(bags.sentence):
        return model
    chosen = evidence(bags, labels)
    length = np.diff(np.concatenate([bags.sentence, [len(bags.word)]]))
    squares, bias_square = np.full(WEIGHTS, 1e-8), 1e-8
    for _ in range(ROUNDS):
        logits = model.logits(bags)
        none = noisy_or(logits, bags.row, rows)
        # Of a clean document the gradient is p, of a toxic one -p (1 - P) / P.
        pull = np.where(labels > 0, np.exp(none) / np.minimum(np.expm1(none), -1e-12), 1.0)
        slope = pull[bags.row] * np.exp(-np.logaddexp(0, -logits))
        words = np.bincount(bags.word, np.repeat(slope, length), len(bags.features))
        change = np.zeros(WEIGHTS)
        for column in bags.features.T:
            change += np.bincount(column, words, WEIGHTS)
        change = np.where(chosen, change + DECAY * model.weights, 0) / rows
        squares += change**2
        model.weights = np.maximum(model.weights - RATE * change / np.sqrt(squares), 0)
        slope = slope.sum() / rows
        bias_square += slope**2
        model.bias -= RATE * slope / np.sqrt(bias_square)
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_train: int = MAX_TRAIN,
) -> Model:
    """Learn from labelled documents whose crc32(id as text) is not divisible by ``folds``."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.where(F.crc32(F.col("id").cast("string")) % folds != 0)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # At most max_train rows of two numbers.
    chosen = texts.join(F.broadcast(known), "id").repartition(1).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, _TRAIN).sort_by([("y", "ascending"), ("text", "ascending")])
        labels = table.column("y").to_numpy()
        model = train(Bags.of_rows(table.column("text")), labels)
        weights = model.weights.astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([weights]), pa.array([model.bias])], ["weights", "bias"])

    row = chosen.mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(row["weights"], "<f4"), row["bias"]) if row else Model(np.zeros(WEIGHTS), PRIOR)


_TRAIN = pa.schema([("text", pa.string()), ("y", pa.int32())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
FIELDS = [
    ("score", "double"),
    ("predicted", "int"),
    ("offending", "array<struct<start: long, end: long, score: double>>"),
]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score``, ``predicted`` and ``offending`` (sentences as places of characters)."""
    shared = Shared(docs.sparkSession, (model.weights, model.bias))

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        own = Model(*shared.value)

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = utf8(piece.column(text))
            bags = Bags.of(data, offsets)
            logits = own.logits(bags)
            scores = -np.expm1(noisy_or(logits, bags.row, piece.num_rows))
            found: list[list] = [[] for _ in range(piece.num_rows)]
            bad = np.flatnonzero(logits >= np.log(OFFENDING / (1 - OFFENDING)))
            if len(bad):
                letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for s in bad.tolist():
                    row = bags.row[s]
                    start, end = (int(letters[x[s]] - letters[offsets[row]]) for x in bags.spans)
                    p = float(np.exp(-np.logaddexp(0, -logits[s])))
                    found[row].append({"start": start, "end": end, "score": p})
            predicted = (scores >= 0.5).astype(np.int32)
            return [pa.array(scores), pa.array(predicted), pa.array(found, _SPANS)]

        return work

    return with_columns(docs, text, FIELDS, make)
