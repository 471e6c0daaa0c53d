"""Hashed word and character n-grams of whole texts, for linear models over their mean.

A model that is linear in the mean of its features needs one number for each feature. Then all character
n-grams of a word, and the word itself, collapse into one sum for each distinct word, which is kept in a
bounded dictionary; only pairs of neighbouring words are looked up for each position. So scoring costs a
few numpy passes over the word numbers of a batch, whatever the number of n-grams.

Words are runs of anything but ASCII white space, as bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Entries of the dictionary of words before it is emptied.
CACHE = 200_000
_MIX = np.uint32(0x9E3779B1)
_PAIR = np.uint32(0x85EBCA6B)


@dataclass(frozen=True)
class Space:
    """The hashed feature space: 2**bits buckets for words, character n-grams of these sizes and word pairs."""

    bits: int = 18
    sizes: tuple[int, ...] = (3, 4)
    pairs: bool = True

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * _MIX) >> np.uint32(32 - self.bits)

    def pair_buckets(self, hashes: np.ndarray) -> np.ndarray:
        """The buckets of neighbouring words; a word that repeats the one before has a bucket of its own, whatever it is."""
        return self.bucket(np.where(hashes[:-1] == hashes[1:], np.uint32(1), hashes[:-1] * _PAIR + hashes[1:]))


def word_features(words: Sequence[bytes], space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, buckets of all features, numbers of features per word): the word and its n-grams.

    A word is marked by a blank on either side; all windows are hashed in one pass over the joined bytes.
    """
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    joined = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # of the blank before each word
    word_of = np.repeat(np.arange(len(words)), lengths + 1)
    ends = (starts + lengths + 2)[word_of]  # behind the blank after the word
    places = np.arange(len(word_of))
    # the word's own hash: a polynomial over its bytes, by sums of position-weighted bytes
    powers = np.cumprod(np.full(int(lengths.max()) + 2, 0x01000193, np.uint32), dtype=np.uint32)
    weighted = (joined[: len(word_of)] + np.uint32(1)) * powers[places - starts[word_of]]
    own = np.add.reduceat(weighted, starts, dtype=np.uint32)
    own ^= own >> np.uint32(15)
    features, owners = [space.bucket(own ^ np.uint32(0xA5A5))], [np.arange(len(words))]
    hashes = joined[: len(word_of)]
    for n in range(2, max(space.sizes, default=1) + 1):
        shifted = joined[n - 1 :]
        hashes = (hashes[: len(shifted)] * np.uint32(0x01000193)) ^ shifted
        if n in space.sizes:
            fits = np.flatnonzero(places[: len(hashes)] + n <= ends[: len(hashes)])
            features.append(space.bucket(hashes[fits] + np.uint32(n)))
            owners.append(word_of[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return own, np.concatenate(features)[order], np.bincount(owner, minlength=len(words))


class Lexicon:
    """Numbers for words, with the sums of a model's weights over their features."""

    def __init__(self, space: Space, weights: np.ndarray):
        self.space, self.weights = space, weights.astype(np.float32)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint32)
        self.sums = np.zeros(0, np.float64)
        self.counts = np.zeros(0, np.int64)

    def numbers(self, texts: Sequence[Sequence[bytes]]) -> np.ndarray:
        """The numbers of all words of all texts, one after another. Numbers hold until the next call."""
        if len(self.number) > CACHE:
            self._clear()
        known: set[bytes] = set()
        known.update(*texts)
        if new := list(known.difference(self.number)):
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            hashes, features, counts = word_features(new, self.space)
            self.hashes = np.concatenate([self.hashes, hashes])
            self.sums = np.concatenate([self.sums, np.add.reduceat(self.weights[features], np.cumsum(counts) - counts, dtype=np.float64)])
            self.counts = np.concatenate([self.counts, counts])
        get = self.number.__getitem__
        return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, words), np.int64, len(words)) for words in texts)])

    def means(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The mean weight over the features of each text; 0 for a text without words."""
        sums, counts = self.sums[numbers], self.counts[numbers]
        if self.space.pairs and len(numbers) > 1:
            hashes = self.hashes[numbers]
            pair = self.weights[self.space.pair_buckets(hashes)].astype(np.float64)
            inner = np.ones(len(numbers), bool)
            inner[np.cumsum(lengths)[lengths > 0] - 1] = False  # the last word of each text begins no pair
            inner = inner[:-1]
            sums[:-1] += np.where(inner, pair, 0)
            counts[:-1] += inner
        return segment_sums(sums, lengths) / np.maximum(segment_sums(counts, lengths), 1)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive segments, each from its own values only; empty segments give 0."""
    out = np.zeros(len(lengths), np.float64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full], dtype=np.float64)
    return out


@dataclass(frozen=True)
class SparseMeans:
    """The shares of the features of each text, rows behind one another: 8 bytes an entry."""

    cuts: np.ndarray  # (texts + 1,) where each row begins
    buckets: np.ndarray  # int32
    shares: np.ndarray  # float32, summing to 1 in each row that has any

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[i], self.cuts[i + 1]
        return self.buckets[a:b], self.shares[a:b]

    def blocks(self, n: int = 256):
        """(rows, buckets, shares, row numbers inside) of so many texts at a time."""
        for at in range(0, len(self), n):
            rows = np.arange(at, min(at + n, len(self)))
            a, b = self.cuts[rows[0]], self.cuts[rows[-1] + 1]
            yield rows, self.buckets[a:b], self.shares[a:b], np.repeat(rows - at, np.diff(self.cuts[rows[0] : rows[-1] + 2]))


def sparse_means(texts: Sequence[bytes], space: Space) -> SparseMeans:
    """The features of each text."""
    sizes, buckets, shares = [0], [], []
    for text in texts:
        words = text.split()
        if not words:
            sizes.append(0)
            continue
        distinct = list(dict.fromkeys(words))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        seq = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        hashes, features, counts = word_features(distinct, space)
        weight = np.repeat(np.bincount(seq, minlength=len(distinct)), counts)
        if space.pairs:
            own = hashes[seq]
            features = np.concatenate([features, space.pair_buckets(own)])
            weight = np.concatenate([weight, np.ones(len(own) - 1, np.int64)])
        found, back = np.unique(features, return_inverse=True)
        total = np.bincount(back, weights=weight)
        sizes.append(len(found))
        buckets.append(found.astype(np.int32))
        shares.append((total / total.sum()).astype(np.float32))
    all_buckets = np.concatenate([np.zeros(0, np.int32), *buckets])
    del buckets
    return SparseMeans(np.cumsum(sizes), all_buckets, np.concatenate([np.zeros(0, np.float32), *shares]))
