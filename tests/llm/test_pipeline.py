"""The corpus pipeline stage by stage, each against brute force over its own input."""

import hashlib

import corpus_pipeline
from corpuslab.llm import mixing
from tests.llm.tables import SF, documents, write
from tests.llm.test_near_dedup import brute
from tests.llm.test_quality import brute as counts


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF).cache()
        assert now.columns == columns
        seen[name] = before, now
    labelled = spark.read.parquet(f"{SF}/labels.parquet")
    for name in ("quality_rules", "quality_classifier"):
        before, after = seen[name]
        assert after.exceptAll(before).count() == 0
        assert after.join(labelled.filter("quality = 0"), "doc_id").count() == 0
    before, after = seen["quality_rules"]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.join(labelled.filter("quality = 1"), "doc_id").collect():
        n, *_, repeated = counts(r["text"])
        assert (r["doc_id"] in kept) == (n >= 50 and 100 * repeated <= 50 * n)
    before, after = seen["near_dedup"]
    want, _ = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == set(want.values())
    before, after = seen["mixing"]
    takes = {r["doc_id"]: r["repetitions"] for r in mixing.mix(before).collect() if r["repetitions"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == takes
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert len(out) == now.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) // 4 for r in out)


def test_run_gives_the_same_rows_again(spark):
    rows = [sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2)]
    assert rows[0] == rows[1]
    assert rows[0]


def test_empty_corpus(spark, tmp_path):
    write(documents(spark, []), tmp_path)
    write(spark.read.parquet(f"{SF}/labels.parquet").limit(0), tmp_path, "labels")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
