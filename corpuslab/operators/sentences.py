"""Sentence boundaries learned from a corpus without labels (FN-22), after Kiss and Strunk's published method.

A full stop ends a sentence or belongs to an abbreviation. Which types are abbreviations, which words begin sentences and which
words stand together across a full stop is counted over all texts: one pass gives each token with its number, and with what follows it
where it ends in a full stop. Tests of likelihood over these counts give three small sets, which split texts in Arrow batches.

Every member of a set makes up at least ``share`` of all tokens, so a set has at most 1 / ``share`` members, whatever the corpus.

Defined cases: null and blank texts have no sentences and teach nothing; repeated rows count each; a corpus without full stops has
empty sets, with which every full stop ends a sentence unless a lower-case word follows; an empty table likewise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.functions import arrow_udf

from corpuslab.functions.fuzzy import mapped
from corpuslab.session import materialise

_OPEN, _CLOSE = "\"'([“‘«", "\"')\\]”’»"
#: A token that a full stop ends, closing marks aside.
STOPPED = rf"\.[{_CLOSE}]*$"
#: What is left off a token's ends; the word itself is in lower case.
ENDS = rf"^[{re.escape(_OPEN)}]+|[{_CLOSE},;:]+$"
#: Levels of the tests: abbreviations by the weighted likelihood ratio, the others by Dunning's ratio.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: The share of an abbreviation's occurrences that have a full stop, as the alternative has it.
STOPS = 0.99


@dataclass(frozen=True)
class Boundaries:
    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    collocations: frozenset[tuple[str, str]] = frozenset()


def word_type(token: Column) -> Column:
    """The word in lower case, without marks around it and without a full stop behind it."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), ENDS, ""), r"\.$", "")


def abbreviation_score(stopped: Column, plain: Column, word: Column, rate: Column) -> Column:
    """The likelihood ratio of "always with a full stop" against the rate of all tokens, less for long words and for each time without one, more for inner full stops."""
    ratio = 2 * (stopped * (F.log(F.lit(STOPS)) - F.log(rate)) + plain * (F.log(F.lit(1 - STOPS)) - F.log1p(-rate)))
    inner = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = F.length(word) - inner
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -plain.cast("double"))


def dunning(first: Column, second: Column, both: Column, n: Column) -> Column:
    """Dunning's likelihood ratio of two words following one another, from the counts of each and of both."""

    def fit(k: Column, of: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(of - k > 0, (of - k) * F.log1p(-p)).otherwise(0.0)

    p, p1, p2 = second / n, both / first, F.when(n > first, (second - both) / (n - first)).otherwise(0.0)
    return -2 * (fit(both, first, p) + fit(second - both, n - first, p) - fit(both, first, p1) - fit(second - both, n - first, p2))


def learn(texts: DataFrame, text: str = "text", least: int = 5, share: float = 1e-6) -> Boundaries:
    """The three sets. A member occurs at least ``least`` times and makes up at least ``share`` of all tokens."""
    tokens = texts.select(F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ").alias("tokens"))
    each = tokens.select(F.explode(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.when(t.contains(".") & t.rlike(STOPPED), F.coalesce(F.get("tokens", i + 1), F.lit(""))).alias("next")))).alias("x"))
    raw = each.select("x.token", "x.next").filter("token <> ''").groupBy("token", "next").agg(F.count(F.lit(1)).alias("n"))
    types = raw.select(word_type(F.col("token")).alias("word"), F.when(F.col("next").isNotNull(), word_type(F.col("next"))).alias("next"), F.col("next").isNotNull().alias("stop"), "n")
    # written by types, of which there are fewer than tokens and which all counts below would make again
    typed = materialise(types.groupBy("word", "next", "stop").agg(F.sum("n").alias("n")), "tokens")
    counts = typed.groupBy("word").agg(F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("stopped"), F.sum("n").alias("n"))
    totals = typed.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("stops")).first()
    n, stops = totals["n"] or 0, totals["stops"] or 0
    if not 0 < stops < n:
        return Boundaries()
    enough = max(least, -(-n * share // 1))
    score = abbreviation_score(F.col("stopped"), F.col("n") - F.col("stopped"), F.col("word"), F.lit(stops / n))
    abbreviations = materialise(counts.filter((F.col("n") >= enough) & (F.col("stopped") > 0) & F.col("word").rlike(r"\p{L}")).filter(score >= ABBREVIATION).select("word"), "abbreviations")
    followed = typed.filter("next <> ''")
    total = counts.select(F.col("word").alias("next"), F.col("n").alias("n_next"))
    # what follows full stops that end sentences
    after = followed.join(abbreviations, "word", "left_anti").groupBy("next").agg(F.sum("n").alias("both"))
    ends = after.agg(F.sum("both")).first()[0] or 0
    tested = after.filter(F.col("both") >= enough).join(total, "next")
    more = F.col("both") / F.lit(float(max(ends, 1))) > F.col("n_next") / F.lit(float(n))
    starters = tested.filter(more & F.col("next").rlike(r"^\p{L}") & (dunning(F.lit(float(max(ends, 1))), F.col("n_next"), F.col("both"), F.lit(float(n))) >= STARTER))
    # what follows abbreviations
    beside = followed.join(abbreviations, "word", "left_semi").groupBy("word", "next").agg(F.sum("n").alias("both")).filter(F.col("both") >= enough)
    joint = beside.join(counts.select("word", F.col("n").alias("n_word")), "word").join(total, "next")
    more = F.col("both") / F.col("n_word") > F.col("n_next") / F.lit(float(n))
    collocations = joint.filter(more & (dunning(F.col("n_word"), F.col("n_next"), F.col("both"), F.lit(float(n))) >= COLLOCATION))
    return Boundaries(
        frozenset(r["word"] for r in abbreviations.collect()), frozenset(r["next"] for r in starters.select("next").collect()), frozenset((r["word"], r["next"]) for r in collocations.select("word", "next").collect())
    )


#: The last mark of a token that another follows. It is looked for without the token before it, which would be tried from each of its characters.
_MARKED = re.compile(rf"([.!?])[{_CLOSE}]*(?=\s+(\S+))")
_ENDS = re.compile(ENDS)


def _type(token: str) -> str:
    return _ENDS.sub("", token.lower()).removesuffix(".")


def split_by(text: str | None, model: Boundaries) -> list[str]:
    """A text's sentences. No sentence ends before a word in lower case. A full stop behind an abbreviation or an initial ends one only if
    a word that begins sentences follows with a capital, and the two don't belong together."""
    if not text or not text.strip():
        return []
    out, begin = [], 0
    for m in _MARKED.finditer(text):
        mark, following = m.groups()
        first = following.lstrip(_OPEN)[:1]
        if first.islower():
            continue
        if mark == ".":
            at = m.start()
            while at and not text[at - 1].isspace():
                at -= 1
            word, then = _type(text[at : m.end()]), _type(following)
            if (word in model.abbreviations or (len(word) == 1 and word.isalpha())) and not (then in model.starters and first.isupper() and (word, then) not in model.collocations):
                continue
        out.append(text[begin : m.end()].strip())
        begin = m.end()
    return [*out, rest] if (rest := text[begin:].strip()) else out


def splitter(model: Boundaries) -> Callable[[Column], Column]:
    """Texts to arrays of sentences, an Arrow batch at a time."""

    @arrow_udf(ST.ArrayType(ST.StringType()))
    def run(text: pa.Array) -> pa.Array:
        return mapped(text, lambda t: split_by(t, model), pa.list_(pa.string()))

    return run


def counter(model: Boundaries) -> Callable[[Column], Column]:
    """Texts to numbers of sentences."""

    @arrow_udf(ST.IntegerType())
    def run(text: pa.Array) -> pa.Array:
        return mapped(text, lambda t: len(split_by(t, model)), pa.int32())

    return run
