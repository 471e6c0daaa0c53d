"""A trained scorer of (question, passage) pairs behind RET-09's protocol (UDF-03).

What it learns from is the corpus itself: words of a text, some in their order and some replaced by words of other texts, are a question that
this text answers and that the texts most like it among the others don't. Features say how much of the question a passage holds, weighed by how
rare its words are in all texts; a small network puts them together. Passages are scored whole, in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.retrieval import TOKEN, default_terms, rows_of_hits

#: Bits of the table of word frequencies: its size is fixed, words that share a place share a frequency.
BITS = 16
#: Texts of the fit, and characters of each that it looks at. Scores look at whole passages.
ROWS, LONGEST = 1500, 4000
WORDS, HIDDEN, STEPS, OTHERS, WRONG = (4, 12), 8, 400, 24, 4
FEATURES = 7


def terms(text: str | None) -> list[str]:
    return re.findall(TOKEN, (text or "").lower())


def place(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Frequencies:
    """In how many texts words of each place occur, of how many texts, and the mean number of words."""

    texts: int
    words: float
    table: np.ndarray

    def rarity(self, term: str) -> float:
        return float(np.log1p((self.texts + 1) / (self.table[place(term)] + 0.5)))


def frequencies(texts: DataFrame, text: str = "text") -> Frequencies:
    """Of all texts; words are counted in the tasks, and 2^16 numbers at most come to the driver."""
    found = texts.select(default_terms(F.coalesce(text, F.lit(""))).alias("terms"))
    # a null beside a text's words counts the text and its words, so that one pass gives all
    each = found.select(F.size("terms").cast("long").alias("words"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("terms"))).alias("term"))
    place = F.crc32(F.encode("term", "utf-8")).bitwiseAND(F.lit((1 << BITS) - 1))
    places = each.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    table, texts_n, words = np.zeros(1 << BITS), 0, 0
    for at, n, total in places.toLocalIterator():
        if at is None:
            texts_n, words = n, total
        else:
            table[at] = n
    return Frequencies(texts_n, words / max(texts_n, 1) or 1.0, table)


def features(question: Sequence[str], passage: Sequence[str], known: Frequencies) -> np.ndarray:
    """What a pair of word lists is judged by; zeros where either is empty."""
    if not question or not passage:
        return np.zeros(FEATURES)
    asked = sorted(set(question))
    rarity = {t: known.rarity(t) for t in asked}
    count = dict.fromkeys(asked, 0)
    for t in passage:
        if t in count:
            count[t] += 1
    held, whole = [t for t in asked if count[t]], sum(rarity.values())
    long = 0.25 + 0.75 * len(passage) / known.words
    share, rare = len(held) / len(asked), sum(rarity[t] for t in held) / whole
    dense = sum(rarity[t] * count[t] / (count[t] + 1.2 * long) for t in held) / whole
    pairs = set(zip(question, question[1:], strict=False))
    order = len(pairs & set(zip(passage, passage[1:], strict=False))) / max(1, len(pairs))
    rarest = max(asked, key=lambda t: (rarity[t], t))
    return np.array([share, rare, dense, order, float(count[rarest] > 0), rare * order, np.tanh(np.log(long))])


@dataclass(frozen=True)
class Model:
    known: Frequencies
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def predict(self, pairs: Sequence[tuple[str | None, str | None]]) -> np.ndarray:
        """The probability that a passage answers its question; a pair without words in both has 0."""
        lists = [(terms(q), terms(p)) for q, p in pairs]
        x = np.array([features(q, p, self.known) for q, p in lists]).reshape(-1, FEATURES)
        score = 1 / (1 + np.exp(-(np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2)))
        return np.where([bool(q and p) for q, p in lists], score, 0.0)


def made_pairs(texts: Sequence[str], known: Frequencies, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 for the text that a question is made of and 0 for others) of questions made of texts."""
    rng, words = np.random.default_rng(seed), [terms(t) for t in texts]
    use = [w for w in words if len(w) >= 2 * WORDS[1]]
    x, y = [], []
    for own in use:
        n = int(rng.integers(*WORDS, endpoint=True))
        at = int(rng.integers(0, len(own) - 3))
        question = own[at : at + 3] + [own[i] for i in rng.integers(0, len(own), n - 3)]
        others = [use[i] for i in rng.integers(0, len(use), OTHERS) if use[i] != own]
        for i in np.flatnonzero(rng.random(len(question)) < 0.25):
            if others:
                question[i] = str(rng.choice(others[0]))
        wrong = sorted((features(question, o, known) for o in others), key=lambda f: (-f[1], *f))[:WRONG]
        x += [features(question, own, known), *wrong]
        y += [1.0] + [0.0] * len(wrong)
    return np.array(x).reshape(-1, FEATURES), np.array(y)


def fit(texts: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS, seed: int = 42) -> Model:
    """Learned from questions made of the ``rows`` texts whose keys have the least hashes; word frequencies are those of all texts."""
    known = frequencies(texts, text)
    drawn = texts.filter(F.length(text) > 0).select(F.xxhash64(key).alias("draw"), F.substring(text, 1, LONGEST).alias("own")).orderBy("draw", "own").limit(rows)
    x, y = made_pairs([r["own"] for r in drawn.collect()], known, seed)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for step in range(1, STEPS + 1 if len(y) else 1):
        hidden = np.tanh(x @ p[0] + p[1])
        wrong = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - y) / len(y)
        back = wrong[:, None] * p[2] * (1 - hidden**2)
        for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ wrong, wrong.sum(keepdims=True))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(known, p[0], p[1], p[2], float(p[3][0]))


def pair_scorer(model: Model, question: str, texts: DataFrame, key: str = "doc_id", text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """UDF-03 for ``retrieval.rerank``: adds rerank_score to candidates (id, ...); null, empty and missing texts have 0."""

    def score(candidates: DataFrame) -> DataFrame:
        passages = rows_of_hits(candidates, texts.select(F.col(key).alias("key of pair"), F.col(text).alias("text of pair")), "key of pair")
        joined = candidates.join(passages, "id", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("text of pair")
                found = model.predict([(question, t) for t in batch.column(at).to_pylist()])
                kept = [i for i in range(batch.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, pa.float64())], [*(batch.schema.names[i] for i in kept), "rerank_score"])

        kind = joined.drop("text of pair").schema.add("rerank_score", "double")
        return joined.mapInArrow(run, kind)

    return score
