"""One-to-one assignment in rounds, batched search in tiles, and the segmented index, against plain loops and rebuilds."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab import session
from corpuslab.functions import text as T
from corpuslab.operators import joins
from corpuslab.operators import retrieval as R


def sequential(pairs):
    used, out = set(), set()
    for ratio, block, a, b in sorted(pairs, key=lambda p: (-p[0], p[2], p[3])):
        if (block, "a", a) not in used and (block, "b", b) not in used:
            used |= {(block, "a", a), (block, "b", b)}
            out.add((block, a, b, round(ratio, 12)))
    return out


def test_rounds_make_the_sequential_choice(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    left = [("big" if rng.random() < 0.7 else f"b{rng.randrange(3)}", word()) for _ in range(120)] + [("big", None), (None, "ab"), ("big", "same"), ("big", "same")]
    right = [("big" if rng.random() < 0.7 else f"b{rng.randrange(3)}", word()) for _ in range(120)] + [("big", None), (None, "ab"), ("big", "same")]
    x, y = spark.createDataFrame(left, "block string, a string"), spark.createDataFrame(right, "block string, b string")
    form = {r[0]: r[1] for df, c in ((x, "a"), (y, "b")) for r in df.select(c, T.match_form(F.col(c))).collect()}
    ratio = {(p, q): difflib.SequenceMatcher(None, form[p], form[q]).ratio() for p in {a for _, a in left if a} for q in {b for _, b in right if b}}
    pairs = {(ratio[a, b], k, a, b) for k, a in left for j, b in right if k is not None and k == j and a and b and ratio[a, b] >= 0.45}
    got = joins.greedy_pairs(x, y, "block", "a", "b")
    assert got.columns == ["block", "a", "b", "ratio"]
    rows = got.collect()
    assert len(rows) > 60
    assert {(r["block"], r["a"], r["b"], round(r["ratio"], 12)) for r in rows} == sequential(pairs)
    assert joins.greedy_pairs(x.limit(0), y, "block", "a", "b").collect() == []


def test_tiles_keep_the_best(monkeypatch):
    monkeypatch.setattr(R, "TILE_ROWS", 16)
    rng = np.random.default_rng(2)
    shard, queries = rng.integers(-3, 4, (100, 5)).astype(float), rng.integers(-3, 4, (7, 5)).astype(float)
    own = rng.permutation(100)
    query, score, found = R.topk_of_shard(own, shard, queries, 4)
    for q in range(7):
        want = sorted(zip((-(shard @ queries[q])).tolist(), own.tolist(), strict=True))[:4]
        assert list(zip((-score[query == q]).tolist(), found[query == q].tolist(), strict=True)) == want
    assert len(R.topk_of_shard(own[:2], shard[:2], queries, 4)[0]) == 14


def test_batched_search_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_BYTES", 400)
    monkeypatch.setattr(R, "TILE_ROWS", 3)
    nan = float("nan")
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(40)] + [(100, None), (101, [nan, 1.0]), (102, [None, 1.0]), (103, [1.0, 2.0, 3.0]), (104, [2.0, 0.0, 1.0]), (105, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in R.dense_topk_batch(df, df.filter("vec_id in (1, 7, 100, 101, 103)"), 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    whole = {k: v for k, v in rows if k is not None and v is not None and all(x is not None and x == x for x in v)}
    want = {q: [(i + 1, k, -s) for i, (s, k) in enumerate(sorted((-dot(whole[q], v), k) for k, v in whole.items() if len(v) == len(whole[q])))][:3] for q in (1, 7, 103)}
    assert {q: sorted(v) for q, v in got.items()} == want


def scores(df):
    return {r[0]: pytest.approx(r[1], rel=1e-12) for r in df.collect()}


def test_segments_score_as_a_rebuild(spark, tmp_path):
    texts = [(i, " ".join(random.Random(i).choices(["red", "green", "blue", "cat", "dog", "sun"], k=5 + i % 7)) if i % 11 else None) for i in range(90)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index, asked = f"file://{tmp_path}/index", ["red", "dog", "absent"]
    R.bm25_index(df(texts[:40]), index)
    R.bm25_append(df(texts[40:60]), index)
    assert scores(R.bm25_from_index(spark, index, asked)) == scores(R.bm25_scores(df(texts[:60]), asked))
    R.bm25_delete(df(texts[5:20] + texts[45:50]).select("doc_id"), index)
    kept = texts[:5] + texts[20:45] + texts[50:60]
    assert scores(R.bm25_from_index(spark, index, asked)) == scores(R.bm25_scores(df(kept), asked))
    R.bm25_delete(df([(7, ""), (500, "")]).select("doc_id"), index)  # gone already, never there
    R.bm25_append(df([(6, "red red dog")] + texts[60:]), index)  # one comes back with another text
    kept += [(6, "red red dog"), *texts[60:]]
    assert scores(R.bm25_from_index(spark, index, asked)) == scores(R.bm25_scores(df(kept), asked))
    assert R.bm25_from_index(spark, index, []).collect() == []


def test_an_attempt_that_failed_is_not_read(spark, tmp_path):
    index = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "red"), (2, "dog red")], "doc_id long, text string")
    R.bm25_index(docs, index)
    spark.createDataFrame([("red", 9, 1, 1, 1)], "term string, doc_id long, dl long, segment int, tf long").write.parquet(f"{index}/segments/00000001-x/postings")
    assert scores(R.bm25_from_index(spark, index, ["red"])) == scores(R.bm25_scores(docs, ["red"]))


def test_new_files_are_appended_and_a_cleaned_index_is_built_again(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/docs"
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    read = lambda: spark.read.parquet(path)
    split = []
    append = R.bm25_append
    monkeypatch.setattr(R, "bm25_append", lambda docs, *a, **b: (split.append(sorted(r[0] for r in docs.select("doc_id").collect())), append(docs, *a, **b)))
    write([(1, "red dog"), (2, "cat")])
    folder = R.stored_index(read(), read())
    assert R.stored_index(read(), read()) == folder
    write([(3, "red red sun")])
    assert R.stored_index(read(), read()) == folder
    assert split == [[1, 2], [3]]
    assert scores(R.bm25_from_index(spark, folder, ["red"])) == scores(R.bm25_scores(read(), ["red"]))
    session.clean(spark)
    again = R.stored_index(read(), read())
    assert again != folder and split[2:] == [[1, 2, 3]]
    assert scores(R.bm25_from_index(spark, again, ["red"])) == scores(R.bm25_scores(read(), ["red"]))
