"""Stylometric features of a text (STY-01..10): 31 metrics, rates per thousand words of the summed chunk counts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.functions import arrow_udf

from corpuslab.functions import text as T
from corpuslab.functions.fuzzy import mapped, split_sentences

#: What each rate counts. ``{name}`` stands for the surname of self-citations.
RATES = {
    "hedge_per_1k": r"(?i)\b(?:perhaps|maybe|might|could|seems?|appear(?:s|ed)?|arguably|suggests?|suggest(?:ing|ed)?|possibly|likely|probable|probably|tentatively?|uncertain|unclear|it\s+is\s+possible|one\s+might|may\s+be)\b",
    "assert_per_1k": r"(?i)\b(?:clearly|necessarily|obviously|certainly|must|indeed|undoubtedly|always|never|inevitably|fundamentally|essentially|demonstrates?|demonstrate(?:d|ing)?|shows?|show(?:ed|ing)?|proves?|prove(?:d|n|ing)?|establishes?)\b",
    "causal_per_1k": r"(?i)\b(?:therefore|thus|hence|consequently|as\s+a\s+result)\b",
    "contrast_per_1k": r"(?i)\b(?:however|nevertheless|nonetheless|although|whereas|yet|while|on\s+the\s+other\s+hand|in\s+contrast)\b",
    "additive_per_1k": r"(?i)\b(?:furthermore|moreover|additionally|in\s+addition|also|as\s+well\s+as)\b",
    "exemplify_per_1k": r"(?i)\b(?:for\s+example|for\s+instance|such\s+as|e\.g\.|as\s+illustrated|as\s+shown)\b",
    "i_per_1k": r"\b(?:I|me|my|mine|myself)\b",
    "we_per_1k": r"(?i)\b(?:we|our|us|ourselves)\b",
    "passive_per_1k": r"(?i)\b(?:was|were)\s+(?:\w+ly\s+)?\w+ed\b",
    "semicolon_per_1k": r";",
    "emdash_per_1k": r"—|(?<!\s)--(?![\s>])",
    "colon_per_1k": r"(?<!\d):(?!\d)",
    "citation_per_1k": r"(?:[A-Z][a-z]+(?:\s+et\s+al\.?|\s+&\s+[A-Z][a-z]+)?)(?:,\s*|\s+)\(?\d{4}[a-z]?\)?",
    "self_cite_per_1k": r"(?i){name}(?:\s+et\s+al\.?|\s+&\s+[^,()]{1,40})?(?:,\s*|\s+)\(?\d{4}[a-z]?\)?",
    "metalinguistic_per_1k": r"(?i)\bthis\s+(?:paper|chapter|article|study|analysis|book|essay|section)\s+(?:argues?|shows?|demonstrates?|examines?|explores?|investigates?|presents?|proposes?|suggests?|contends?|claims?)|\bI\s+(?:argue|show|demonstrate|claim|propose|suggest|examine|explore|contend|maintain|assert)\b",
    "definitional_per_1k": r"(?i)\b(?:is\s+defined\s+as|refers?\s+to|(?<!\w)means?|is\s+called|is\s+known\s+as|that\s+is(?:\s+to\s+say)?|i\.e\.|in\s+other\s+words|to\s+put\s+it\s+(?:another\s+way|simply|differently))\b",
    "subordinate_per_1k": r"(?i)\b(?:because|although|since|unless|whereas|despite|even\s+though|so\s+that|in\s+order\s+(?:to|that)|given\s+that|provided\s+that|assuming\s+that)\b",
}
#: The letters that what a rate counts can begin with, looked at before its alternatives are tried one by one.
FIRST = {
    "hedge_per_1k": "acilmopstu", "assert_per_1k": "acdefimnopsu", "causal_per_1k": "acht", "contrast_per_1k": "ahinowy", "additive_per_1k": "afim", "exemplify_per_1k": "aefs",
    "i_per_1k": "Im", "we_per_1k": "ouw", "definitional_per_1k": "imrt", "subordinate_per_1k": "abdegipsuw",
}
#: Patterns that find the same, written so that a character of the match is looked for first.
QUICK = {
    "emdash_per_1k": r"[—\-](?:(?<=—)|(?<!\s-)-(?![\s>]))",
    "colon_per_1k": r":(?<!\d:)(?!\d)",
    "metalinguistic_per_1k": rf"(?i)(?=[it])(?:{RATES['metalinguistic_per_1k'].removeprefix('(?i)')})",
} | {name: RATES[name].replace(r"\b(?:", rf"\b(?=[{letters}])(?:", 1) for name, letters in FIRST.items()}
ABSTRACT = r"(?:tion|ity|ness|ment|ism|ance|ence|ivity)$"
LONG_SENTENCE, SHORT_SENTENCE, COMPLEX_SYLLABLES = 30, 10, 3


def count_matches(text: Column, name: str, surname: str = "Ander") -> Column:
    return F.regexp_count(text, F.lit((QUICK.get(name) or RATES[name]).replace("{name}", surname)))


def rate(count: Column, words: Column) -> Column:
    return F.when(words > 0, F.round(count / (words / 1000), 3)).otherwise(0.0)


def per_1k(text: Column, words: Column, name: str, surname: str = "Ander") -> Column:
    """A rate; 0.0 without words."""
    return rate(count_matches(text, name, surname), words)


def hedge_ratio(h: Column, a: Column, words: Column) -> Column:
    """STY-04: hedges among hedges and assertions; 0.5 where there are none."""
    return F.when((words > 0) & (h + a > 0), F.round(h / (h + a), 4)).otherwise(0.5)


def hapax(low: Column) -> Column:
    """Words found once, by a fold over the sorted list: the run that is open, and how many runs of one are closed."""
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("once"))

    def step(s: Column, word: Column) -> Column:
        same = s["word"].eqNullSafe(word)
        closed = s["once"] + F.when(~same & (s["run"] == 1), 1).otherwise(0)
        return F.struct(word.alias("word"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), closed.alias("once"))

    return F.aggregate(low, start, step, lambda s: s["once"] + F.when(s["run"] == 1, 1).otherwise(0))


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is made once, however often fn names it.

    Being a lambda, it also keeps loops over matches out of the one method that Spark makes of a stage, which the JVM leaves uncompiled when it is long.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def token_counts(low: Column, bare: Column) -> dict[str, Column]:
    """Counts over the sorted lower-case tokens in one string, each with a blank behind it; ``bare`` has no silent e. Syllables by the rule of ``T.syllables``."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    return {
        # equal tokens follow one another
        "types": count(low, r"([^ ]++ )\1*+"),
        "repeated": count(low, r"(?<![^ ])([^ ]++ )\1++"),
        "abstract": count(low, ABSTRACT.replace("$", " ")),
        "syllables": count(bare, r"[aeiouy]++") + count(bare, r"(?<![^ ])[^aeiouy ]++ "),
        "complex": count(bare, rf"(?<![^ ])(?:[^aeiouy ]*+[aeiouy]++){{{COMPLEX_SYLLABLES}}}[^ ]*+ "),
    }


#: What ``token_counts`` leaves off before it counts syllables.
SILENT = r"(?<=[^ ][^aeiouy ])e "


def vocabulary(counts: Column, n: Column) -> dict[str, Column]:
    """STY-03, of the counts over n tokens."""
    share = lambda x, digits: F.when(n > 0, F.round(x / n, digits)).otherwise(0.0)
    return {
        "ttr": share(counts["types"], 4),
        "mean_word_len": share(counts["characters"], 3),
        "abstract_ratio": share(counts["abstract"], 4),
        "hapax_ratio": share(counts["types"] - counts["repeated"], 4),
    }


_RHYTHM = ST.StructType([ST.StructField("lengths", ST.ArrayType(ST.IntegerType())), ST.StructField("questions", ST.IntegerType())])


def rhythm_of(text: str) -> dict:
    """Words of each sentence, between ASCII white space as Java's patterns have it, and how many sentences are questions."""
    found = split_sentences(text)
    return {"lengths": [len(s.encode().split()) for s in found], "questions": sum(s.endswith("?") for s in found)}


@arrow_udf(_RHYTHM)
def rhythm(text: pa.Array) -> pa.Array:
    """Numbers of a text's sentences, which stay in the worker."""
    return mapped(text, rhythm_of, pa.struct([("lengths", pa.list_(pa.int32())), ("questions", pa.int32())]))


def sentence_rhythm(lengths: Column, questions: Column) -> dict[str, Column]:
    """STY-01, of the sentences' word counts; the deviation is the population's."""
    n = F.size(lengths)
    mean = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x) / n
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x * x) / n
    given = lambda x: F.when(n > 0, F.round(x, 2)).otherwise(0.0)
    return {
        "sent_count": n.cast("double"),
        "sent_mean_words": given(mean),
        "sent_std_words": given(F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean))),
        "sent_pct_long": given(100 * F.size(F.filter(lengths, lambda x: x > LONG_SENTENCE)) / n),
        "sent_pct_short": given(100 * F.size(F.filter(lengths, lambda x: x < SHORT_SENTENCE)) / n),
        "pct_questions": given(100 * questions / n),
    }


def readability(counts: Column, n: Column, n_sentences: Column) -> dict[str, Column]:
    """STY-02, of the counts over n tokens."""
    asl, asw = n / n_sentences, counts["syllables"] / n
    complex_share = 100 * counts["complex"] / n
    given = lambda x: F.when((n > 0) & (n_sentences > 0), F.round(x, 2)).otherwise(0.0)
    return {"flesch_ease": given(206.835 - 1.015 * asl - 84.6 * asw), "fk_grade": given(0.39 * asl + 11.8 * asw - 15.59), "fog_index": given(0.4 * (asl + complex_share))}


RATE_ORDER = ("hedge_per_1k", "assert_per_1k", "hedge_assert_ratio", *list(RATES)[2:])


def features(texts: DataFrame, text: str = "text", words: str = "words", surname: str = "Ander") -> DataFrame:
    """STY-10: all 31 metrics behind the frame's own columns. Sentences come from one Arrow UDF as numbers, the rest is built in.

    The tokens are one sorted string, in which patterns count: an expression for each token costs far more than its characters.
    """
    body, n_words = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(words), F.lit(0))
    struct = lambda columns: F.struct(*(c.alias(name) for name, c in columns.items()))

    def of_low(low: Column, n: Column) -> Column:
        return once(F.regexp_replace(low, SILENT, " "), lambda bare: struct({"n": n, "characters": F.length(low) - n} | token_counts(low, bare)))

    def of_tokens(tokens: Column) -> Column:
        low = F.array_join(F.sort_array(F.split(F.lower(F.array_join(tokens, " ")), " ")), " ")
        return once(F.when(F.size(tokens) > 0, F.concat(low, F.lit(" "))).otherwise(F.lit("")), lambda x: of_low(x, F.size(tokens)))

    both = lambda t: struct({"hedges": count_matches(t, "hedge_per_1k", surname), "assertions": count_matches(t, "assert_per_1k", surname)})
    parsed = texts.withColumns({"_rhythm": rhythm(body), "_counts": once(T.word_tokens(body), of_tokens), "_claims": once(body, both)})
    hedges, assertions = F.col("_claims.hedges"), F.col("_claims.assertions")
    rates = {"hedge_per_1k": rate(hedges, n_words), "assert_per_1k": rate(assertions, n_words), "hedge_assert_ratio": hedge_ratio(hedges, assertions, n_words)}
    rates |= {name: per_1k(body, n_words, name, surname) for name in RATE_ORDER if name not in rates}
    counts, n, lengths = F.col("_counts"), F.col("_counts.n"), F.col("_rhythm.lengths")
    metrics = sentence_rhythm(lengths, F.col("_rhythm.questions")) | readability(counts, n, F.size(lengths)) | vocabulary(counts, n) | rates
    return parsed.select(*texts.columns, *(c.alias(name) for name, c in metrics.items()))


METRICS = (
    "sent_count", "sent_mean_words", "sent_std_words", "sent_pct_long", "sent_pct_short", "pct_questions", "flesch_ease", "fk_grade", "fog_index", "ttr", "mean_word_len", "abstract_ratio", "hapax_ratio", *RATE_ORDER,
)
