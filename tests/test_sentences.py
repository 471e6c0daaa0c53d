"""Learned sentence boundaries against a plain-Python version of the counts, the tests and the splitting."""

import math
import re
from collections import Counter

import pytest

from corpuslab.operators import sentences as S

OPEN, CLOSE = "\"'([“‘«", "\"')]”’»"


def word_of(token):
    token = token.lower().lstrip(OPEN).rstrip(CLOSE + ",;:")
    return token[:-1] if token.endswith(".") else token


def stopped(token):
    return token.rstrip(CLOSE).endswith(".")


def likelihood(k, n, p):
    return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)


def ratio(c1, c2, c12, n):
    p2 = (c2 - c12) / (n - c1) if n > c1 else 0
    return -2 * (likelihood(c12, c1, c2 / n) + likelihood(c2 - c12, n - c1, c2 / n) - likelihood(c12, c1, c12 / c1) - likelihood(c2 - c12, n - c1, p2))


def learned(texts, least):
    every, stops, pairs = Counter(), Counter(), Counter()
    for text in texts:
        tokens = re.split(r"[ \t\n\x0b\f\r]+", (text or "").strip(" \t\n\x0b\f\r"))
        for i, t in enumerate(tokens):
            if t:
                every[word_of(t)] += 1
                if stopped(t):
                    stops[word_of(t)] += 1
                    if i + 1 < len(tokens) and word_of(tokens[i + 1]):
                        pairs[word_of(t), word_of(tokens[i + 1])] += 1
    n, rate = sum(every.values()), sum(stops.values()) / max(1, sum(every.values()))
    abbreviations = set()
    for w, a in stops.items():
        b, inner = every[w] - a, w.count(".")
        if every[w] >= least and any(c.isalpha() for c in w):
            score = 2 * (a * math.log(0.99 / rate) + b * (math.log(0.01) - math.log(1 - rate)))
            size = len(w) - inner
            if score * math.exp(-size) * (inner + 1) * size**-b >= 0.3:
                abbreviations.add(w)
    after = Counter()
    for (w, x), c in pairs.items():
        if w not in abbreviations:
            after[x] += c
    ends = sum(after.values())
    starters = {x for x, c in after.items() if c >= least and x[0].isalpha() and c / ends > every[x] / n and ratio(ends, every[x], c, n) >= 30}
    together = {(w, x) for (w, x), c in pairs.items() if w in abbreviations and c >= least and c / every[w] > every[x] / n and ratio(every[w], every[x], c, n) >= 7.88}
    return abbreviations, starters, together


def split(text, abbreviations, starters, together):
    out, now = [], []
    spans = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
    for i, (token, start, end) in enumerate(spans):
        now.append((start, end))
        if i + 1 == len(spans):
            break
        bare, then = token.rstrip(CLOSE), spans[i + 1][0]
        first = then.lstrip(OPEN)[:1]
        if bare[-1:] not in (".", "!", "?") or first.islower():
            continue
        w, x = word_of(token), word_of(then)
        if bare.endswith(".") and (w in abbreviations or (len(w) == 1 and w.isalpha())):
            if not (x in starters and first.isupper() and (w, x) not in together):
                continue
        out.append(text[now[0][0] : now[-1][1]])
        now = []
    return [*out, text[now[0][0] : now[-1][1]]] if now else out


PROSE = [
    f"The {a} met Dr. Smith at approx. 5 pm. The {b} left (see fig. 3). They said no, e.g. twice. It was {c} vs. {a}. The end of it? Yes! \"Stop.\" He went home."
    for a in ("cat", "dog", "fox", "hen") for b in ("man", "boy", "girl", "king", "queen") for c in ("one", "two", "three")
] + [f"We use approx. The same as they do with {a}. The rest is silence, said J. R. Brown etc. The {a} slept." for a in ("lamp", "door", "wall", "roof")] + ["They go home and stop twice in the pm hours, not for the first time, and then they went home"] * 30 + [None, "", "  \n ", "one", "no stop here"]


@pytest.mark.parametrize("least", [3, 5])
def test_learned_sets_are_those_of_a_plain_count(spark, least):
    df = spark.createDataFrame([(t,) for t in PROSE], "text string")
    model = S.learn(df, least=least)
    want = learned(PROSE, least)
    assert (set(model.abbreviations), set(model.starters), set(model.collocations)) == want
    assert {"dr", "fig", "vs", "e.g"} <= model.abbreviations and "home" not in model.abbreviations
    assert "the" in model.starters and ("dr", "smith") in model.collocations
    got = [r["s"] for r in df.select(S.splitter(model)("text").alias("s")).collect()]
    assert got == [split(t, *want) for t in PROSE]
    assert S.split_by("Dr. Smith came. He saw fig. 3. The end.", model) == ["Dr. Smith came.", "He saw fig. 3.", "The end."]


def test_documents(spark):
    """The query's rows, from a model learned on the table, one by one."""
    from corpuslab.plans.catalog import queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = learned([r["text"] for r in rows], 5)
    got = {r["doc_id"]: r["n"] for r in queries()["sentence_counts"](spark, sf).collect()}
    assert got == {r["doc_id"]: len(split(r["text"], *want)) for r in rows}


def test_nothing_to_learn(spark):
    for rows in ([], [(None,)], [("no stops at all",)], [("only. stops. here.",)]):
        assert S.learn(spark.createDataFrame(rows, "text string")) == S.Boundaries()
    assert S.split_by("One two. Three 3. four", S.Boundaries()) == ["One two.", "Three 3. four"]


def test_texts_of_any_length():
    text = "He came at once. " * 50_000
    assert len(S.split_by(text, S.Boundaries())) == 50_000


def test_long_tokens_take_linear_time_and_counts_need_no_sentences(spark):
    """A token without a mark isn't tried from each of its characters."""
    import time

    from corpuslab.operators import sentences

    start = time.perf_counter()
    assert len(sentences.split_by("x" * 100_000 + " Then. End", sentences.Boundaries())) == 2
    assert time.perf_counter() - start < 5
    df = spark.createDataFrame([(1, "One. Two? three Dr. X."), (2, None), (3, " ")], "i int, t string")
    assert [r["n"] for r in df.select("i", sentences.counter(sentences.Boundaries())("t").alias("n")).orderBy("i").collect()] == [3, 0, 0]
