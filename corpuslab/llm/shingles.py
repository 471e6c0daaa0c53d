"""Hashed word shingles of whole texts, by numpy over the bytes of a batch: no Python object for each word.

Bytes and words are handled ``CHUNK`` at a time, so that a text of any length, or a word of any length,
needs little more than its words' hashes (eight bytes a word) beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20240229)
_BYTE = np.where(_BLANK, 0, _rng.integers(1, 1 << 63, 256, dtype=np.int64)).astype(np.uint64)
_IN_WORD, _IN_SHINGLE, _DIGEST_A, _DIGEST_B = (np.uint64(int(x) | 1) for x in _rng.integers(1 << 61, 1 << 63, 4, dtype=np.int64))
#: Bytes, or words, that are handled at a time.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64), dtype=np.uint64)])


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _polynomials(values: np.ndarray, segments: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sums of values times powers of the base, from power 0 in each of the consecutive segments, which begin at 0."""
    sizes = np.diff(segments, append=len(values))
    offset = np.arange(len(values)) - np.repeat(segments, sizes)
    return np.add.reduceat(values * _powers(base, int(sizes.max()))[offset], segments)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit hashes) of the words of UTF-8 bytes that end in a blank."""
    places, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    inside = 0  # bytes so far of a word that goes on into this chunk
    for at in range(0, len(raw), CHUNK):
        chunk = raw[at : at + CHUNK]
        blank = _BLANK[chunk]
        starts = np.flatnonzero(~blank & np.concatenate([[not inside], blank[:-1]]))
        goes_on = bool(inside and not blank[0])
        segments = np.concatenate([[0], starts]) if goes_on else starts
        if len(segments):
            own = _polynomials(_BYTE[chunk[segments[0] :]], segments - segments[0], _IN_WORD)
            if goes_on:
                last = next(x for x in reversed(sums) if len(x))
                last[-1:] += own[:1] * _power(_IN_WORD, inside)
                own = own[1:]
            places.append(starts + at)
            sums.append(own)
        if blank[-1]:
            inside = 0
        else:
            inside = len(chunk) - int(segments[-1]) + (inside if goes_on and len(segments) == 1 else 0)
    return np.concatenate(places), mix(np.concatenate(sums))


@dataclass(frozen=True)
class Shingled:
    """Of a batch of texts: words, a 128-bit digest of the word sequence, and the distinct shingles.

    hashes and counts are in the order of (text, hash); sizes has the number of distinct shingles per text.
    """

    n_words: np.ndarray
    digest: np.ndarray  # (texts, 2) int64
    hashes: np.ndarray  # uint32
    counts: np.ndarray
    sizes: np.ndarray

    def packed(self) -> list[bytes]:
        """Per text, its hashes in ascending order, each as often as it is found."""
        cuts = np.cumsum([0, *self.sizes])
        return [np.repeat(self.hashes[a:b].astype("<u4"), self.counts[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def distinct(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, sizes) without repetition, from hashes that ascend in each text, and their numbers per text."""
    first = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    ends = np.cumsum(sizes)
    first[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(first)
    return hashes[at], np.diff(at, append=len(hashes)).astype(np.int32), np.diff(np.searchsorted(at, ends), prepend=0)


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, sizes) of texts whose hashes are packed."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    return distinct(np.frombuffer(b"".join(packed), "<u4"), sizes)


def shingle(texts: list[bytes], width: int = 5) -> Shingled:
    """Shingles of ``width`` words; a text with fewer words, but one, is one shingle."""
    raw = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    starts, words = word_hashes(raw)
    cuts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))
    del raw, starts
    n_words = np.diff(cuts)
    digest = np.zeros((len(texts), 2), np.uint64)
    sizes = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    found = [np.zeros(0, np.uint32)]
    for a in range(0, len(words), CHUNK):
        b = min(a + CHUNK, len(words))
        # the texts that the chunk touches; the first may have begun before it
        t = np.flatnonzero((cuts[:-1] < b) & (cuts[1:] > a) & (n_words > 0))
        begin = np.maximum(cuts[t], a) - a
        for j, base in enumerate((_DIGEST_A, _DIGEST_B)):
            own = _polynomials(words[a:b], begin, base)
            own[:1] *= _power(base, max(0, a - int(cuts[t[0]])))
            digest[t, j] += own
        # a shingle begins at every word that has width - 1 more behind it, and at the first word of any text
        left = np.repeat(cuts[t + 1], np.diff(begin, append=b - a)) - np.arange(a, b)
        padded = np.concatenate([words[a : b + width - 1], np.zeros(max(0, b + width - 1 - len(words)), np.uint64)])
        total = np.zeros(b - a, np.uint64)
        for j in range(width):
            total = total * _IN_SHINGLE + np.where(left > j, padded[j : j + b - a], np.uint64(0))
        begins = left >= width
        begins[begin[cuts[t] >= a]] = True
        found.append((mix(total[begins]) >> np.uint64(32)).astype(np.uint32))
    full = n_words > 0
    digest[full] = mix(digest[full] + n_words[full].astype(np.uint64)[:, None])
    del words
    hashes = np.concatenate(found)
    del found
    if len(texts) == 1:
        hashes.sort()
    else:
        keys = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(32), sizes) | hashes
        keys.sort()
        hashes = keys.astype(np.uint32)
    hashes, counts, sizes = distinct(hashes, sizes)
    return Shingled(n_words, digest.view(np.int64), hashes, counts, sizes)
