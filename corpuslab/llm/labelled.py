"""A bounded, seeded sample of labelled texts, for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Texts in a sample, and the characters of a text that it takes at most; both are parameters of every fit.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000


def excerpt(text: str, chars: int, seed: int) -> Column:
    """The whole text, or a run of ``chars`` characters from a seeded place of a longer one."""
    length = F.char_length(text)
    start = F.pmod(F.xxhash64(text, F.lit(seed)), F.greatest(length - chars + 1, F.lit(1))).cast("int") + 1
    return F.when(length <= chars, F.col(text)).otherwise(F.substring(F.col(text), start, F.lit(chars)))


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(label_id, label): the documents whose labels, if they have several, all say the same."""
    given = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).filter("label_id IS NOT NULL AND label IN (0, 1)")
    return given.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 7) -> list[Row]:
    """(label, draw, doc_id, text) of up to ``rows`` labelled documents; of texts longer than ``chars`` an excerpt from any place.

    Half of the places go to each label, where it has so many. Labels are drawn first, in the order of a
    seeded hash and half as many again as needed, in case documents are missing. The draw is bounded by
    ``rows``, so the join that fetches the texts broadcasts a bounded table and the corpus is read once.
    Documents with conflicting labels teach nothing; of the texts that share a doc_id the least one is
    taken. The sample is the same in whatever order the rows of both tables come.
    """
    clean = agreed(labels, label)
    draw = F.xxhash64("label_id", F.lit(seed))
    drawn = [clean.filter(F.col("label") == value).withColumn("draw", draw).orderBy("draw", "label_id").limit(rows * 3 // 4) for value in (0, 1)]
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).select("doc_id", excerpt("text", chars, seed).alias("text"))
    found = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("doc_id") == F.col("label_id"))
    ordered = sorted(found.groupBy("label", "draw", "doc_id").agg(F.min("text").alias("text")).collect())
    return [r for value in (0, 1) for r in [r for r in ordered if r["label"] == value][: rows // 2]]


def shares(labels: DataFrame, label: str) -> tuple[float, float]:
    """The shares of labels 0 and 1; a half each where there are none."""
    counts = {r[0]: r[1] for r in agreed(labels, label).groupBy("label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    return (n0 / (n0 + n1), n1 / (n0 + n1)) if n0 + n1 else (0.5, 0.5)
