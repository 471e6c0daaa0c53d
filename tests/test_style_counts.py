"""Counts of the style metrics by one pattern over all tokens, and patterns that look for a first letter, against the plain ones."""

import random

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import style

PARTS = [
    "perhaps", "It is possible", "one might", "CLEARLY", "Must", "as a\nresult", "On the  other hand", "e.g.", "i.e.", "that is to say", "means", "I argue", "this Paper shows", "provided that", "in order to", "I", "me", "us", "ours",
    "—", "--", " --", "-->", "a--b", "---", " ---", "1:2", "a:b", "::", "1:", "tree's", "-e", "xe", "eye", "the", "bee", "ity", "activity", "nation", "rhythm", "don't", "straße", "ſuch as", "KelvinK", "é", "?", ". A", "\x1c", " ", "ab ab", "aab ab",
]


def test_counts(spark):
    rng = random.Random(5)
    texts = ["", " ", *PARTS, *("".join(rng.choice(PARTS) + rng.choice((" ", " ", "", "\n")) for _ in range(rng.randint(1, 60))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("words", T.word_count(F.col("text")))
    plain = [F.regexp_count("text", F.lit(style.RATES[name])).alias(name) for name in style.QUICK]
    quick = [style.count_matches(F.col("text"), name).alias(f"quick {name}") for name in style.QUICK]
    for row in df.select("text", *plain, *quick).collect():
        assert {n: row[n] for n in style.QUICK} == {n: row[f"quick {n}"] for n in style.QUICK}, row["text"]
    # each token by itself
    tokens = df.select("id", F.transform(T.word_tokens(F.col("text")), F.lower).alias("low"), F.transform(T.word_tokens(F.col("text")), T.syllables).alias("syllables"))
    want = {r["id"]: r for r in tokens.collect()}
    for row in style.features(df).collect():
        low, syllables = want[row["id"]]["low"], want[row["id"]]["syllables"]
        n = len(low) or 1
        assert abs(row["ttr"] - len(set(low)) / n) < 1e-4 and abs(row["hapax_ratio"] - sum(low.count(t) == 1 for t in low) / n) < 1e-4
        assert abs(row["mean_word_len"] - sum(map(len, low)) / n) < 1e-3
        if low:
            assert abs(row["flesch_ease"] - (206.835 - 1.015 * len(low) / row["sent_count"] - 84.6 * sum(syllables) / n)) < 0.01
            assert abs(row["fog_index"] - 0.4 * (len(low) / row["sent_count"] + 100 * sum(x >= 3 for x in syllables) / n)) < 0.01


def test_sentences_stay_numbers():
    assert style.rhythm_of("Is it so? Yes\x1cnay. It is one word.") == {"lengths": [3, 1, 4], "questions": 1}
