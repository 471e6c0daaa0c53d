"""Licence notices in paragraphs (operator 4).

A paragraph is a run of lines between blank ones; its lines are joined, as they may be wrapped. Sparse word
n-grams (one to three words, lower case, letters and digits only, hashed) of each paragraph go to a
multinomial logistic regression over licence families, ``unknown`` (a licence of no listed family) and
``none``. It is trained on variants of notice templates and of the paragraphs of whole licences; probabilities
are calibrated by a temperature fitted on variants that the training didn't see. A family is reported if
its calibrated probability is the largest and at least ``LEAST``, and a template of the family confirms it: the share of
the shorter one's word pairs that the other has, with ``SHARED`` pairs at least (or all of a template of fewer); a title
must be the whole line or paragraph. What looks like a licence (a class has ``LEAST``, or all but ``none``
together all but ``CHANCE``) but isn't confirmed is ``unknown``, with the probability of being any licence.

Every paragraph of every whole text is scored. Beside paragraphs and single lines of up to the longest of
``WIDTHS`` words, overlapping windows of these widths are scored, as the prose around a notice would outweigh
it otherwise: a short notice fits into one wherever it stands, and a long one into a run of them. A window
counts unless one of the same width that overlaps it has more evidence against ``none`` (so a notice cut
short doesn't stand for the whole one), or a confirmed one of any width does. Confirmed windows of one
family that are less than ``GAP`` words apart are one notice. All notices of a paragraph are reported.

A licence has several paragraphs: those of one family that follow one another, with one between them at most
(a line of copyright), are one notice, reported for the first of them. What is unknown next to a confirmed notice, in its paragraph, the one before or the one
behind, is taken for a part of it, and so is a reservation of rights that a licence follows.

Features that training never saw weigh nothing, so windows without any other have the score of the biases,
which is that of ``none``; numpy finds those that have one in a few passes over the bytes, and only these
are looked at in Python. Nothing is shuffled.

Defined cases: null and blank texts have no rows; repeated rows are scanned each; classes of equal probability
give the first, windows of equal evidence the first; paragraphs of any length are covered by windows from end
to end (a text is the least piece that a task holds, with some hundred bytes a word); a null key stays; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslab.llm.common import pieces, utf8
from corpuslab.llm.license_texts import IDENTIFIERS, PARAGRAPHS, TITLES
from corpuslab.llm.shingles import mix, word_hashes

BITS, LONGEST = 20, 3
LEAST, CONFIRM = 0.6, 0.6
NONE, UNKNOWN = "none", "unknown"
#: Words of a window; each begins a quarter of its width after the one before. Lines and paragraphs of up to the last are scored whole too.
WIDTHS = (12, 24, 48)
#: Marks in place of a width: a whole paragraph, a whole line.
PARAGRAPH, LINE = 0, -1
#: Word pairs that a window must share with a template, and words between windows of one notice at most.
SHARED, GAP = 3, 48
#: Where no class has LEAST, or in a window, which is one of many of its paragraph, ``unknown`` needs a probability of none this small:
#: a few words of prose that training knows from a notice spread LEAST over many families as well.
CHANCE = 0.05
#: (window, feature) pairs that are scored at a time.
SCORED = 1 << 18

#: Notices of each family, as projects commonly word them.
TEMPLATES = {
    "MIT": (
        "released under the mit license", "licensed under the mit license", "this project is licensed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    ),
    "Apache-2.0": (
        "licensed under the apache license version 2.0", "this project is released under the apache 2.0 license", "you may not use this file except in compliance with the apache license",
        "licensed to the apache software foundation under one or more contributor license agreements",
    ),
    "GPL": (
        "this work is licensed under the gnu general public license version 3", "licensed under the gpl version 2", "released under the gnu gpl v3", "distributed under the terms of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "LGPL": ("licensed under the gnu lesser general public license version 3", "released under the lgpl version 2.1", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    "AGPL": ("licensed under the gnu affero general public license version 3", "released under the agpl v3", "under the terms of the gnu affero general public license as published by the free software foundation"),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "released under the mpl 2.0"),
    "BSD": (
        "released under the bsd license", "licensed under the 3 clause bsd license", "licensed under the bsd 2 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "ISC": ("released under the isc license", "licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "CC-BY": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "released under the creative commons attribution license"),
    "CC-BY-SA": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "text is available under the creative commons attribution sharealike license"),
    "CC-BY-NC": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "released under cc by nc"),
    "CC-BY-ND": ("licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"),
    "CC0": ("released under cc0 1.0", "dedicated to the public domain under cc0", "this work is in the public domain", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    "Unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense"),
    "Proprietary": ("all rights reserved", "copyright all rights reserved", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
}
#: What names no listed family, {} standing for a made-up name.
UNKNOWN_TEMPLATES = ("licensed under the {} license", "released under the {} public license version 2", "this work is made available under the terms of the {} license agreement", "use of this material is governed by the {} licence", "distributed under the {} community license")
#: Wordings that are near a notice and aren't one.
OTHER_TEMPLATES = (
    "he was released under bail", "the driver had no license plate", "she is a licensed driver in this state", "the terms of the agreement were public", "all seats are reserved", "reserved for the rights of the people", "the general public was informed",
    "the mit campus is open to visitors", "apache tribes lived in the south", "version 2 of the program", "the software was free of charge", "creative people work in the commons", "this work is in progress", "under the bridge and over the hill",
    "the public domain of the town", "the work entered the public domain in 1950", "his books have been in the public domain since the year 1923", "songs of that time are in the public domain", "copyright c 2020 by the author", "copyright 1998 2003",
    "the software is provided to schools", "no warranty was given with the car", "she was free to use any of these", "permission was granted by the court", "a copy of this letter", "the following conditions were met", "distributed to all of the people", "any purpose with or without reason",
)
#: The most common function words: prose is full of them and must not look like a notice.
FUNCTION_WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also".split()


#: (family, template): titles and identifiers, and the paragraphs of whole licences.
SHORT = [(f, t) for f, texts in TITLES.items() for t in texts] + [(f, f"SPDX-License-Identifier: {t}") for f, texts in IDENTIFIERS.items() for t in texts]
LONG = [(f, t) for f, texts in PARAGRAPHS.items() for t in texts]


def normal_words(text: str) -> list[str]:
    """Lower-case words of letters and digits; dots inside numbers stay."""
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def _grams(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, places of the first word, numbers of words) of all n-grams of a sequence of word hashes; none crosses a line."""
    found, places, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(words), np.uint64)
    for n in range(1, LONGEST + 1):
        last = len(words) - n + 1
        if last <= 0:
            break
        total = total[:last] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]
        same = np.flatnonzero(line[:last] == line[n - 1 :])
        found.append((mix(total + np.uint64(n)) >> np.uint64(64 - BITS))[same].astype(np.int64))
        places.append(same)
    sizes = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return np.concatenate(found), np.concatenate(places), sizes


#: Bytes as the features see them: lower case, anything but ASCII letters, digits, line ends and bytes of longer code points as blanks.
_PLAIN = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100), 0x0A]:
    _PLAIN[_b] = _b
for _b in range(0x41, 0x5B):
    _PLAIN[_b] = _b + 0x20
_DOT = ord(".")


def plain_bytes(raw: np.ndarray) -> np.ndarray:
    """As normal_words has it: a dot before a digit and behind one stays in the number."""
    out = _PLAIN[raw]
    if len(raw) > 2:
        digit = (raw >= 0x30) & (raw <= 0x39)
        inside = np.flatnonzero((raw[1:-1] == _DOT) & digit[:-2] & digit[2:]) + 1
        out[inside] = _DOT
    return out


def _words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, lines, paragraphs of the words; the number of paragraphs before each line) of joined texts."""
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate([[0], ends[:-1] + 1])
    written = np.add.reduceat((~_IS_BLANK[raw]).astype(np.int32), starts) > 0
    begins = written & np.concatenate([[True], ~written[:-1]])
    paragraph = np.cumsum(begins)
    places, words = word_hashes(plain_bytes(raw))
    line = np.searchsorted(ends, places)
    return places, words, line, paragraph[line] - 1, paragraph - begins


_IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _join(texts: list[bytes]) -> bytes:
    """Texts with a blank line behind each."""
    return b"".join(x + b"\n\n" for x in texts) or b"\n"


def _first_lines(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([t.count(b"\n") + 2 for t in texts], np.int64)
    return np.cumsum(sizes) - sizes


def paragraph_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, paragraphs, first paragraph of each text): paragraphs are numbered through all texts."""
    _, words, _, paragraph, before = _words(_join(texts))
    buckets, places, _ = _grams(words, paragraph)
    return buckets, paragraph[places], before[_first_lines(texts)]


@dataclass(frozen=True)
class Windows:
    """Windows that may hold a notice: paragraph, words [begin, end) and the probabilities of the classes."""

    paragraph: np.ndarray
    width: np.ndarray  # or PARAGRAPH, LINE
    begin: np.ndarray
    end: np.ndarray
    odds: np.ndarray  # logarithm of the odds against none
    p: np.ndarray  # (windows, classes)


@dataclass(frozen=True)
class Model:
    classes: list[str]
    column: np.ndarray  # (2**BITS,) int32: a bucket's row in weights, or -1
    weights: np.ndarray  # (known buckets, classes) float32
    bias: np.ndarray
    temperature: float

    def probabilities(self, buckets: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lines that have a known feature, their probabilities); a feature counts once a line."""
        row = self.column[buckets]
        known = row >= 0
        pairs = np.unique(lines[known] * len(self.weights) + row[known]) if known.any() else np.zeros(0, np.int64)
        found, at = np.unique(pairs // max(1, len(self.weights)), return_index=True)
        if not len(found):
            return found, np.zeros((0, len(self.classes)))
        logits = np.add.reduceat(self.weights[pairs % len(self.weights)], at, axis=0) + self.bias
        return found, softmax(logits / self.temperature)


def likely_windows(model: Model, words: np.ndarray, line: np.ndarray, paragraph: np.ndarray) -> Windows:
    """The windows whose odds against none are those of ``LEAST`` and more."""
    buckets, place, size = _grams(words, paragraph)
    feature = model.column[buckets]
    own = feature >= 0
    feature, place, size = feature[own].astype(np.int64), place[own], size[own]
    gain = np.delete(model.weights, 0, axis=1).max(axis=1) - model.weights[:, 0]
    lead = float(model.bias[1:].max() - model.bias[0])
    # no class can lead none by more than the sum of the features' best leads
    least = (np.log(LEAST / (1 - LEAST)) - np.log(max(1, len(model.classes) - 1))) * model.temperature
    parts = []
    for width in (LINE, PARAGRAPH, *WIDTHS):
        whole = line if width == LINE else paragraph
        _, first, length = np.unique(whole, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(first)), length)[place]
        if width > 0:
            step = width // 4
            number = np.where(length > width, -(-(length - width) // step) + 1, 0)
        else:
            step, number = 1, (length <= WIDTHS[-1]).astype(np.int64)
        base = np.cumsum(number) - number
        found = []
        for back in range(4 if width > 0 else 1):
            k = (place - first[at]) // step - back if width > 0 else np.zeros(len(place), np.int64)
            inside = (k >= 0) & (k < number[at])
            if width > 0:
                inside &= place - first[at] + size <= k * step + width
            elif width == LINE:
                inside &= place + size <= first[at] + length[at]
            found.append((base[at[inside]] + k[inside]) * len(model.weights) + feature[inside])
        pairs = np.unique(np.concatenate(found))
        window = pairs // max(1, len(model.weights))
        bound = np.bincount(window, gain[pairs % max(1, len(model.weights))], int(number.sum())) + lead
        pairs = pairs[bound[window] >= least]
        window = pairs // max(1, len(model.weights))
        cuts = np.flatnonzero(np.diff(window, prepend=-1))
        while len(pairs):
            # whole windows, as many as have SCORED pairs, but one
            n = max(1, int(np.searchsorted(cuts, SCORED, side="right")) - 1) if len(pairs) > SCORED else len(cuts)
            stop = int(cuts[n]) if n < len(cuts) else len(pairs)
            logits = (np.add.reduceat(model.weights[pairs[:stop] % len(model.weights)], cuts[:n], axis=0) + model.bias) / model.temperature
            p = softmax(logits)
            other = logits[:, 1:].max(axis=1)
            odds = other + np.log(np.exp(logits[:, 1:] - other[:, None]).sum(axis=1)) - logits[:, 0]
            keep = np.flatnonzero(odds >= np.log(LEAST / (1 - LEAST)))
            ids = window[cuts[:n]][keep]
            which = np.searchsorted(base, ids, side="right") - 1
            begin = first[which] + (ids - base[which]) * step
            end = np.minimum(begin + (width if width > 0 else length[which]), first[which] + length[which])
            parts.append((paragraph[begin], np.full(len(keep), width), begin, end, odds[keep], p[keep]))
            pairs, window, cuts = pairs[stop:], window[stop:], cuts[n:] - stop
    if not parts:
        none = np.zeros(0, np.int64)
        return Windows(none, none, none, none, np.zeros(0), np.zeros((0, len(model.classes))))
    return Windows(*(np.concatenate(x) for x in zip(*parts, strict=True)))


@dataclass
class Notice:
    """Words [begin, end) of a paragraph; template is that of the likeliest window."""

    paragraph: int
    begin: int
    end: int
    license: str
    probability: float
    similarity: float
    confirmed: bool
    template: str

    def add(self, other: Notice) -> None:
        """Another part of the same notice; the first part says where it is."""
        if self.paragraph == other.paragraph:
            self.begin, self.end = min(self.begin, other.begin), max(self.end, other.end)
        if other.probability > self.probability:
            self.probability, self.similarity, self.template = other.probability, other.similarity, other.template


def notices(model: Model, found: Windows, of_paragraph: np.ndarray, text: Callable[[int, int], str]) -> list[Notice]:
    """The notices of a paragraph with these windows, in their order: confirmed ones of all families, and unknown ones."""
    taken: dict[int, list[tuple[int, int]]] = {}
    sure: list[Notice] = []
    unsure: list[Notice] = []
    for i in of_paragraph[np.argsort(-found.odds[of_paragraph], kind="stable")].tolist():
        begin, end = int(found.begin[i]), int(found.end[i])
        stronger = taken.setdefault(int(found.width[i]), [])
        at = bisect_left(stronger, (begin, end))
        if any(a < end and begin < b for a, b in stronger[max(0, at - 1) : at + 1]):
            continue
        stronger.insert(at, (begin, end))
        # what isn't none may be spread over families; the largest one is named only if it has LEAST itself
        best = 1 + int(found.p[i, 1:].argmax())
        family, probability, licensed = model.classes[best], float(found.p[i, best]), 1 - float(found.p[i, 0])
        whole = found.width[i] <= 0
        similarity, template = confirm(family, text(begin, end), whole) if family != UNKNOWN else (0.0, "")
        if family != UNKNOWN and probability >= LEAST and similarity >= CONFIRM:
            if not any(n.begin < end and begin < n.end for n in sure):
                sure.append(Notice(int(found.paragraph[i]), begin, end, family, probability, similarity, True, template))
        elif licensed >= 1 - CHANCE or (probability >= LEAST and whole):
            unsure.append(Notice(int(found.paragraph[i]), begin, end, UNKNOWN, licensed, similarity, False, template))
    out: list[Notice] = []
    for n in sorted(sure, key=lambda n: (n.begin, n.end)):
        last = next((x for x in reversed(out) if x.license == n.license), None)
        if last and n.begin - last.end < GAP:
            last.add(n)
        else:
            out.append(n)
    if out:
        unsure = [n for n in unsure if all(n.begin - x.end >= GAP or x.begin - n.end >= GAP for x in out)]
    for n in sorted(unsure, key=lambda n: (n.begin, n.end)):
        last = out[-1] if out and out[-1].license == UNKNOWN else None
        if last and n.begin - last.end < GAP:
            last.add(n)
        else:
            out.append(n)
    return sorted(out, key=lambda n: n.begin)


def whole_notices(of_text: list[Notice]) -> list[Notice]:
    """The notices of a text, those that go on in the next paragraphs as one."""
    places = {n.paragraph for n in of_text if n.confirmed}
    known = [n for n in of_text if n.confirmed or not places & {n.paragraph - 1, n.paragraph + 1}]
    out: list[Notice] = []
    last_seen: dict[str, tuple[int, Notice]] = {}
    for i, n in enumerate(known):
        follows = known[i + 1] if i + 1 < len(known) else None
        reserved = n.license == RESERVED and follows and follows.confirmed and follows.license != RESERVED and follows.paragraph - n.paragraph <= 1 and (follows.paragraph > n.paragraph or follows.begin - n.end < GAP)
        if reserved:
            continue
        at, part_of = last_seen.get(n.license, (-2, None))
        if part_of is not None and n.confirmed and 1 <= n.paragraph - at <= 2:
            part_of.add(n)
            last_seen[n.license] = (n.paragraph, part_of)
        else:
            out.append(n)
            last_seen[n.license] = (n.paragraph, n)
    return out


RESERVED = "Proprietary"


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_lines(seed: int, variants: int) -> list[tuple[str, str]]:
    """(class, line): templates with words lost or put around them, made-up names, near misses and function words."""
    rng = random.Random(seed)
    made_up = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    around = lambda n: [rng.choice(FUNCTION_WORDS) if rng.random() < 0.7 else made_up() for _ in range(rng.randint(0, n))]

    def vary(text: str, loss: float) -> str:
        words = [w for w in text.split() if rng.random() >= loss]
        return " ".join([*around(6), *words, *around(6)])

    def part(text: str) -> str:
        """What a window sees of a long paragraph."""
        words = normal_words(text)
        n = min(len(words), rng.randint(10, WIDTHS[-1]))
        at = rng.randint(0, len(words) - n)
        return " ".join(words[at : at + n])

    out = []
    for family, texts in TEMPLATES.items():
        out += [(family, t) for t in texts] + [(family, vary(t, 0.06)) for t in texts for _ in range(variants)]
    for family, t in SHORT:
        out += [(family, t)] * max(1, variants // 4) + [(family, vary(t, 0.0)) for _ in range(max(1, variants // 4))]
    for family, t in LONG:
        out += [(family, t)] + [(family, vary(part(t), 0.03)) for _ in range(variants * max(1, len(normal_words(t)) // 24))]
    out += [(UNKNOWN, vary(t.format(made_up()), 0.04)) for t in UNKNOWN_TEMPLATES for _ in range(4 * variants)]
    out += [(NONE, vary(t, 0.05)) for t in OTHER_TEMPLATES for _ in range(variants)]
    out += [(NONE, " ".join(rng.choice(FUNCTION_WORDS) if rng.random() < 0.6 else made_up() for _ in range(rng.randint(1, 60)))) for _ in range(30 * variants)]
    return out


def train(seed: int = 9, variants: int = 12, steps: int = 120, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Multinomial logistic regression by Adam, then the temperature on lines of another seed."""
    classes = [NONE, UNKNOWN, *TEMPLATES]
    rows, held = training_lines(seed, variants), training_lines(seed + 1, max(2, variants // 4))

    def features(lines: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buckets, line, _ = paragraph_features([t.encode() for _, t in lines])
        return buckets, line, np.array([classes.index(c) for c, _ in lines])

    buckets, line, y = features(rows)
    # a feature counts once a line, and those of a single line (made-up words) teach nothing
    each = np.unique(line * (1 << BITS) + buckets)
    line, buckets = each >> BITS, each & ((1 << BITS) - 1)
    known, seen = np.unique(buckets, return_counts=True)
    known = known[seen > 1]
    column = np.full(1 << BITS, -1, np.int32)
    column[known] = np.arange(len(known))
    kept = column[buckets] >= 0
    line, feature = line[kept], column[buckets[kept]]
    by_feature = np.argsort(feature, kind="stable")
    begins = np.searchsorted(feature[by_feature], np.arange(len(known)))
    lines, at = np.unique(line, return_index=True)
    y = y[lines]
    row = np.searchsorted(lines, line)
    w, b = np.zeros((len(known), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[0] = 2.0  # without any feature it is none
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = softmax(np.add.reduceat(w[feature], at, axis=0) + b)
        p[np.arange(len(y)), y] -= 1
        g = np.add.reduceat(p[row[by_feature]], begins, axis=0) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = Model(classes, column, w, b, 1.0)
    buckets, line, y = features(held)

    def loss(temperature: float) -> float:
        found, p = Model(classes, column, w, b, temperature).probabilities(buckets, line)
        return -float(np.log(p[np.arange(len(found)), y[found]] + 1e-9).mean())

    return Model(model.classes, column, w, b, min((0.5 + 0.1 * i for i in range(46)), key=loss))


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}


_TEMPLATE_PAIRS = {
    family: [(t, pairs(normal_words(t))) for t in [*texts, *(x for f, x in [*SHORT, *LONG] if f == family and x not in TITLES.get(family, ()))]] for family, texts in TEMPLATES.items()
}
_TITLES = {family: {tuple(normal_words(t)): t for t in texts} for family, texts in TITLES.items()}


def confirm(family: str, found: str, whole: bool) -> tuple[float, str]:
    """(similarity, template): the share of the shorter one's word pairs that the other has, for the best template.

    Too few pairs in common count as none; a title is similar to a whole line or paragraph only.
    """
    words = normal_words(found)
    if whole and (title := _TITLES.get(family, {}).get(tuple(words))):
        return 1.0, title
    own = pairs(words)
    best = [(len(own & t) / min(len(own), len(t)), text) for text, t in _TEMPLATE_PAIRS[family] if len(own & t) >= min(SHARED, len(t))]
    return max(best, default=(0.0, ""))


SCHEMA = "paragraph int, license string, probability double, similarity double, confirmed boolean, template string, notice string"


def scan(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each licence notice: the number of its first paragraph in the text, and what confirms it."""
    # what scoring needs: a sorted list of known buckets is smaller than the table of all
    known = np.flatnonzero(model.column >= 0)
    parts = (model.classes, known, model.weights, model.bias, model.temperature)
    rows = documents.select(key, text)
    names = [key, "paragraph", "license", "probability", "similarity", "confirmed", "template", "notice"]
    kinds = [None, pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, own, weights, bias, temperature = parts
        column = np.full(1 << BITS, -1, np.int32)
        column[own] = np.arange(len(own))
        ready = Model(classes, column, weights, bias, temperature)
        for batch in pieces(batches, weight=2 << 20):
            texts = [x or b"" for x in utf8(batch.column(1))]
            joined = _join(texts)
            starts, words, line, paragraph, before = _words(joined)
            first = before[_first_lines(texts)]
            found = likely_windows(ready, words, line, paragraph)
            keys, out = batch.column(0).to_pylist(), []

            def window(begin: int, end: int, joined: bytes = joined, starts: np.ndarray = starts, line: np.ndarray = line) -> str:
                """Words of a paragraph, with what follows the last one in its line."""
                stop = int(starts[end]) if end < len(starts) and line[end] == line[end - 1] else joined.index(b"\n", starts[end - 1])
                return joined[starts[begin] : stop].decode("utf-8", "replace")

            by_paragraph = np.argsort(found.paragraph, kind="stable")
            cuts = np.flatnonzero(np.diff(found.paragraph[by_paragraph], prepend=-1))
            of_text: dict[int, list[Notice]] = {}
            for own in np.split(by_paragraph, cuts[1:]) if len(cuts) else []:
                doc = int(np.searchsorted(first, found.paragraph[own[0]], side="right")) - 1
                of_text.setdefault(doc, []).extend(notices(ready, found, own, window))
            for doc, have in of_text.items():
                for n in whole_notices(have):
                    out.append((keys[doc], n.paragraph - int(first[doc]), n.license, n.probability, n.similarity, n.confirmed, n.template, window(n.begin, n.end)))
            if out:
                arrays = [pa.array(c, batch.column(0).type if k is None else k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {SCHEMA}")
