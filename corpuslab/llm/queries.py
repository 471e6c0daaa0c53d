"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import byte_bpe, divergence, language, licenses, mixing, near_dedup, packing, quality_classifier, quality_rules, token_files, topk, warc, whitening
from corpuslab.llm.common import fold, table
from corpuslab.session import spread

Query = Callable[[SparkSession, str], DataFrame]


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows cost far more than moving them: dealt over all cores where its files are few."""
    return spread(table(spark, sf_dir, name))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(texts(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("record_id"), "url", F.col("html").cast("binary").alias("payload"))
    return warc.round_trip(pages).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_files.round_trip(texts(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1)
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(texts(spark, sf_dir), licenses.train())
    return found.select("doc_id", "paragraph", "license", "probability", "similarity", "confirmed")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(documents, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(spread(documents), model)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_rules.fit(documents, table(spark, sf_dir, "labels"))
    return quality_rules.score(spread(documents), model)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), byte_pattern()
    both = byte_bpe.round_trip(texts(spark, sf_dir), path, pattern)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = language.fit(documents, fold("doc_id", 4) != 2)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return language.predict(spread(documents), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(texts(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    whitened = whitening.apply(vectors, whitening.fit(vectors, k=4, scale=256), scale=256)
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(texts(spark, sf_dir), least=30, top=50)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(texts(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=1, capacity=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_warc": op2_warc,
        "op3_token_files": op3_token_files,
        "op4_license_scan": op4_license_scan,
        "op5_topk_search": op5_topk_search,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_language_id": op9_language_id,
        "op10_mix_sources": op10_mix_sources,
        "op11_whitening": op11_whitening,
        "op12_source_divergence": op12_source_divergence,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op5_topk_search": topk.ORACLE, "op10_mix_sources": mixing.ORACLE, "op12_source_divergence": divergence.ORACLE}
