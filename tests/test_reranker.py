"""The trained scorer of pairs: its features by a plain count, its batches by one pair at a time, its order on texts it hasn't seen."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import reranker, retrieval
from corpuslab.plans import catalog
from corpuslab.plans.retrieval_queries import _fused, query_terms

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return reranker.fit(docs)


def test_frequencies(docs, model):
    rows = [reranker.terms(r["text"]) for r in docs.select("text").collect()]
    assert model.known.texts == len(rows) and model.known.words == pytest.approx(sum(map(len, rows)) / len(rows))
    table = np.zeros(1 << reranker.BITS)
    for row in rows:
        for t in set(row):
            table[zlib.crc32(t.encode()) % (1 << reranker.BITS)] += 1
    assert (table == model.known.table).all()


def score(model, question, text):
    """By plain loops."""
    q, p = reranker.terms(question), reranker.terms(text)
    if not q or not p:
        return 0.0
    weight = {t: math.log(1 + (model.known.texts + 1) / (model.known.table[reranker.place(t)] + 0.5)) for t in q}
    length = 0.25 + 0.75 * len(p) / model.known.words
    held = [t for t in weight if t in p]
    share, rare = len(held) / len(weight), sum(weight[t] for t in held) / sum(weight.values())
    dense = sum(weight[t] * p.count(t) / (p.count(t) + 1.2 * length) for t in held) / sum(weight.values())
    pairs = {(a, b) for a, b in zip(q, q[1:], strict=False)}
    order = sum(any(p[i] == a and p[i + 1] == b for i in range(len(p) - 1)) for a, b in pairs) / max(1, len(pairs))
    top = max(sorted(weight), key=lambda t: (weight[t], t))
    x = [share, rare, dense, order, float(top in p), rare * order, math.tanh(math.log(length))]
    z = model.b2
    for h in range(len(model.b1)):
        z += model.w2[h] * math.tanh(model.b1[h] + sum(x[f] * model.w1[f, h] for f in range(len(x))))
    return 1 / (1 + math.exp(-z))


def test_query_against_plain_scores(spark, docs, model):
    got = [(r["id"], r["rerank_score"]) for r in catalog.queries()["reranked_by_model"](spark, SF).collect()]
    texts, question = {r["doc_id"]: r["text"] for r in docs.collect()}, " ".join(query_terms(spark, SF))
    candidates = retrieval.best_fused(_fused(spark, SF), 20).collect()
    want = sorted((-score(model, question, texts.get(r["id"])), r["first_seen"], r["id"]) for r in candidates)[:8]
    assert [g[0] for g in got] == [w[2] for w in want]
    assert np.allclose([g[1] for g in got], [-w[0] for w in want])


def test_defined_cases(spark, model):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "ß 123"), (5, "alpha " * 50_000), (5, "beta")], "doc_id int, text string")
    candidates = spark.createDataFrame([(i, i, "x") for i in (1, 2, 3, 4, 5, 6)], "id int, first_seen int, text string")
    got = sorted((r["id"], r["rerank_score"], r["text"]) for r in reranker.pair_scorer(model, "Alpha, beta?", texts)(candidates).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 5, 6] and {g[2] for g in got} == {"x"}
    assert [g[1] for g in got if g[0] in (2, 3, 4, 6)] == [0.0] * 4
    assert sorted(g[1] for g in got if g[0] == 5) == pytest.approx(sorted(score(model, "alpha beta", t) for t in ("alpha " * 50_000, "beta")))
    assert reranker.pair_scorer(model, "alpha", texts)(candidates.limit(0)).collect() == []
    empty = reranker.fit(texts.limit(0))
    assert empty.known.texts == 0 and 0 < empty.predict([("alpha", "alpha")])[0] < 1


def test_order_on_unseen_texts(docs):
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1
    known = reranker.fit(docs.filter(~held))
    texts = [r["text"] for r in docs.filter(held).select("text").distinct().orderBy("text").collect() if r["text"]]
    x, y = reranker.made_pairs(texts, known.known, 7)
    p = 1 / (1 + np.exp(-(np.tanh(x @ known.w1 + known.b1) @ known.w2 + known.b2)))
    starts = np.flatnonzero(y)
    best = [p[s] > p[s + 1 : e].max() for s, e in zip(starts, [*starts[1:], len(y)], strict=True) if e > s + 1]
    assert len(best) > 20 and np.mean(best) >= 0.9


def test_frequencies_read_the_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda t: seen.add(1) or t, "string", useArrow=False)
    texts = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, ""), (4, "beta")], "doc_id long, text string").select("doc_id", counted("text").alias("text"))
    known = reranker.frequencies(texts)
    assert (known.texts, known.words, known.table.sum()) == (4, 1.0, 3)
    assert known.table[reranker.place("beta")] == 2
    assert seen.value == 4
    empty = reranker.frequencies(texts.limit(0))
    assert (empty.texts, empty.words, empty.table.sum()) == (0, 1.0, 0)
    candidates = spark.createDataFrame([(1, 0)], "id long, first_seen int")
    plan = reranker.pair_scorer(reranker.Model(known, *reranker_weights()), "alpha", texts)(candidates)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan


def reranker_weights():
    return np.zeros((reranker.FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0
