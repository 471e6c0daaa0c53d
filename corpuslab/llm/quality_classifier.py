"""Supervised subword embeddings for quality (operator 6).

Each word, its character n-grams and each pair of neighbouring words have a learned vector in a hashed
table. A document is the mean of its vectors; a softmax layer on the mean gives the label. Both are
trained together by stochastic gradient descent in numpy, one document a step, with a falling rate.

For scoring, the softmax layer is applied to the table once: with two labels, the difference of their
logits is linear in the mean, so each bucket has one number, and each distinct word one sum. Whole
texts are scored in Arrow batches; nothing is shuffled.

Defined cases: null and empty texts have the mean 0 and get the score of the biases alone; without
labels of both kinds every score is 0.5; labels of fold 1 of 3 (crc32 of doc_id) are never learned;
documents whose labels conflict teach nothing, and the order of rows doesn't change the model; a text
longer than the sample takes teaches by an excerpt from any of its places and is scored whole (a text is
the least piece that a task holds, with its words); repeated rows are scored alike; a score of exactly
0.5 is predicted 1; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslab.llm import labelled
from corpuslab.llm.common import PIECE_BYTES, fold, pieces, utf8
from corpuslab.llm.ngrams import Lexicon, Space, sparse_means


@dataclass(frozen=True)
class Model:
    space: Space
    vectors: np.ndarray  # (buckets, size): the embedding of each feature
    output: np.ndarray  # (size, 2): the softmax layer
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """Per bucket, what a feature adds to the logit of label 1 over label 0."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)

    @property
    def margin_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[bytes], y: np.ndarray, space: Space, size: int = 16, epochs: int = 8, rate: float = 0.3, seed: int = 11) -> Model:
    """Stochastic gradient descent on the cross entropy of the softmax."""
    rng = np.random.default_rng(seed)
    x = sparse_means(texts, space)
    vectors = rng.uniform(-1 / size, 1 / size, (space.buckets, size)).astype(np.float32)
    output, bias = np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            own, share = x.row(i)
            hidden = share @ vectors[own]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            now = rate * (1 - done / steps)
            # normalised step: the mean moves by the rate times its gradient, however many features it has
            if len(own):
                vectors[own] -= np.outer(share * (np.float32(now) / (share @ share)), output @ p)
            output -= np.float32(now) * np.outer(hidden, p)
            bias -= np.float32(now / 10) * p
            done += 1
    return Model(space, vectors, output, bias)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.SAMPLE_ROWS, chars: int = labelled.SAMPLE_CHARS, space: Space | None = None) -> Model | None:
    """The model from a bounded sample of labelled rows; None without labels of both kinds."""
    found = labelled.sample(documents, labels.filter(fold("doc_id", 3) != 1), label, rows, chars)
    y = np.array([r["label"] for r in found])
    return train([r["text"].encode() for r in found], y, space or Space()) if len(set(y)) == 2 else None


class Scorer:
    def __init__(self, space: Space, margins: np.ndarray, bias: float):
        self._lexicon, self._bias = Lexicon(space, margins), bias

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        words = [x.split() for x in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        logits = self._lexicon.means(self._lexicon.numbers(words), lengths) + self._bias
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def _parts(model: Model | None) -> tuple[Space, np.ndarray, float]:
    """What scoring needs, small enough to be sent with every task."""
    return (model.space, model.margins(), model.margin_bias) if model else (Space(), np.zeros(Space().buckets, np.float32), 0.0)


def score(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of label 1."""
    parts = _parts(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parts)
        for batch in pieces(batches, weight=PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer([x or b"" for x in utf8(batch.column(1))]))], [key, "score"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double")


def keep(documents: DataFrame, model: Model | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose score reaches ``least``, with all their columns."""
    parts = _parts(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parts)
        for batch in pieces(batches, weight=PIECE_BYTES):
            yield batch.filter(pa.array(scorer([x or b"" for x in utf8(batch.column(text))]) >= least))

    return documents.mapInArrow(run, documents.schema)
