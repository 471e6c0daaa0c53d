"""A training corpus from documents: rules, classifier, near-duplicates, mixture, token ids.

Each stage takes all that its predecessor kept. Models are fitted on the labelled rows of the corpus as it
was at first, so that what an early stage removes still teaches a later one what to reject.

Defined cases, for all stages: an empty table gives an empty table; extra columns, whatever their names, pass
through all stages but the last, which returns columns of its own; null and very long texts are handled as the
operators' docstrings say, and each stage states what it does with null ids, repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import byte_bpe, mixing, near_dedup, quality_classifier, quality_rules
from corpuslab.llm.common import table
from corpuslab.llm.queries import byte_pattern, vocabulary
from corpuslab.session import materialise


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated n-gram model.

    Null and blank texts go; a probability of exactly the threshold stays; repeated rows stay or go together;
    null ids are judged like others; without labels of both kinds the base rules alone decide.
    """
    return quality_rules.keep(docs, quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword-embedding classifier takes for good.

    A score of exactly 0.5 stays; repeated rows stay or go together; null ids are judged like others; without
    labels of both kinds all stay.
    """
    return quality_classifier.keep(docs, quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id, null ids last.

    Texts that share a doc_id count each for itself; rows equal in id and text are one; texts without words are
    classes of their own; a similarity of exactly the threshold links.
    """
    return near_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, or not at all.

    A null source is a source of its own; null ids draw by their texts; rows repeated as a whole share a draw and
    are taken as documents of their own; of equal draws the first written row is toggled.
    """
    return mixing.mix_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row of the mixture: repeated rows give repeated rows.

    A null text has no ids, a null id stays null.
    """
    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), byte_pattern()
    both = byte_bpe.round_trip(docs, path, pattern)
    return both.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("near_dedup", remove_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Fitted models and near-duplicate classes can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
