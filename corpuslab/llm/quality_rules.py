"""Quality rules: base counts and a calibrated n-gram model against fixed thresholds (operator 7).

Base rules count words, symbols, repeated lines and repeated three-word windows, each exactly, and fail
short or repetitive texts. The rest is judged by logistic regression over hashed word and character
n-grams (their mean over the whole text), fitted on a bounded sample of labelled rows and calibrated by
Platt's method on rows that the fit didn't see, weighed so that the labels have their natural shares.
A text is kept if its calibrated probability of good quality reaches ``KEEP``.

The model becomes one weight for each bucket (1 MB), sent with the task; Arrow batches are scored by
numpy, and nothing is shuffled.

Defined cases: null and blank texts have no words and fail the base rules; without labels of both
kinds every text that passes the base rules is kept; documents whose labels conflict teach nothing, and
the order of rows doesn't change the model; a text longer than the sample takes teaches by an excerpt
from any of its places and is counted and scored whole (a text is the least piece that a task holds, with
its words); a probability of exactly ``KEEP`` is kept; repeated rows are judged alike; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslab.llm import labelled
from corpuslab.llm.common import PIECE_BYTES, fold, pieces, utf8
from corpuslab.llm.ngrams import Lexicon, Space, SparseMeans, segment_sums, sparse_means

MIN_WORDS = 50
#: Per cent of words in repeated windows above which a text fails.
MAX_REPEATED = 50
#: Calibrated probability of good quality from which a text is kept.
KEEP = 0.5
SYMBOLS = b"#*$%&|<>"
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS)).astype(np.uint8)
#: Bytes that begin a code point and aren't white space.
_IS_CHAR = ((np.arange(256) & 0xC0 != 0x80) & ~np.isin(np.arange(256), list(_BLANKS))).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    """P(good) = sigmoid(slope * (bias + mean weight) + shift)."""

    space: Space
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, means: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (means + self.bias) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logits(x: SparseMeans, w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.bincount(own, share * w[bucket], len(rows)) for rows, bucket, share, own in x.blocks())])


def fit_logistic(x: SparseMeans, y: np.ndarray, used: np.ndarray, n_buckets: int, steps: int = 150, rate: float = 2.0, decay: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on the rows in use, by Adam on the whole gradient, summed block by block."""
    w, b, n = np.zeros(n_buckets), 0.0, used.sum()
    m, v, mb, vb = np.zeros(n_buckets), np.zeros(n_buckets), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = decay * w, 0.0
        for rows, bucket, share, own in x.blocks():
            p = sigmoid(np.bincount(own, share * w[bucket], len(rows)) + b)
            miss = np.where(used[rows], p - y[rows], 0) / n
            g += np.bincount(bucket, share * miss[own], n_buckets)
            gb += miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= 0.02 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, b


def calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's slope and shift, by Newton steps on smoothed targets."""
    n1, n0 = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1.0, float(np.abs(scores).mean()))
    x = np.stack([scores / scale, np.ones_like(scores)])
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(theta @ x)
        gradient = x @ (weight * (p - target)) + 1e-3 * theta
        hessian = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return float(theta[0] / scale), float(theta[1])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.SAMPLE_ROWS, chars: int = labelled.SAMPLE_CHARS, space: Space | None = None) -> Model | None:
    """The model from a bounded sample; None without labels of both kinds. Fold 1 of 3 by crc32 of doc_id is never used."""
    space = space or Space()
    usable = labels.filter(fold("doc_id", 3) != 1)
    found = labelled.sample(documents, usable, label, rows, chars)
    y = np.array([r["label"] for r in found], float)
    if len(set(y)) < 2:
        return None
    x = sparse_means([r["text"].encode() for r in found], space)
    del found
    # every fourth row of each label is kept for calibration
    aside = np.zeros(len(y), bool)
    for value in (0, 1):
        aside[np.flatnonzero(y == value)[3::4]] = True
    if len(set(y[aside])) < 2:
        aside[:] = False
    weights, bias = fit_logistic(x, y, ~aside, space.buckets)
    held = aside if aside.any() else ~aside
    natural = labelled.shares(usable, label)
    weight = np.array([natural[int(v)] / max(1, (y[held] == v).sum()) for v in y[held]]) * held.sum()
    slope, shift = calibrate((logits(x, weights) + bias)[held], y[held], weight)
    return Model(space, weights.astype(np.float32), bias, slope, shift)


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(numbers)
    if n < 4:
        return 0
    if numbers.max() < 1 << 21:
        keys = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        seq = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
        pairs = np.unique(seq[:-1] * n + seq[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * n + seq[2:]
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    again = np.unique(again)
    at = np.flatnonzero(again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys)
    covered = np.zeros(n, bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(texts: list[bytes], lexicon: Lexicon, model: Model | None) -> dict[str, np.ndarray]:
    """The counts, base_failed, score and kept of each text."""
    words = [x.split() for x in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    numbers = lexicon.numbers(words)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    found = {
        "n_words": lengths,
        "word_chars": segment_sums(_IS_CHAR[raw], sizes).astype(np.int64),
        "n_symbols": segment_sums(_IS_SYMBOL[raw], sizes).astype(np.int64),
        "n_dup_lines": np.fromiter(map(repeated_lines, texts), np.int64, len(texts)),
        "n_repeat_words": np.fromiter((repeated_words(numbers[b - n : b]) for b, n in zip(ends, lengths, strict=True)), np.int64, len(texts)),
    }
    found["base_failed"] = (lengths < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED * lengths)
    found["score"] = model.probability(lexicon.means(numbers, lengths)) if model else np.ones(len(texts))
    found["kept"] = ~found["base_failed"] & (found["score"] >= KEEP)
    return found


def _lexicon(model: Model | None) -> Lexicon:
    return Lexicon(model.space, model.weights) if model else Lexicon(Space(), np.zeros(Space().buckets, np.float32))


def score(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, the counts, base_failed, score (calibrated probability), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(model)
        for batch in pieces(batches, weight=PIECE_BYTES):
            found = judge([x or b"" for x in utf8(batch.column(1))], lexicon, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], [key, *found])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def keep(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(model)
        for batch in pieces(batches, weight=PIECE_BYTES):
            found = judge([x or b"" for x in utf8(batch.column(text))], lexicon, model)
            yield batch.filter(pa.array(found["kept"]))

    return documents.mapInArrow(run, documents.schema)
