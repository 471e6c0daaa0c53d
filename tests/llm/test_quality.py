"""Operators 6 and 7: counts by brute force, verdicts by held-out labels."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import labelled, quality_classifier, quality_rules
from corpuslab.llm.ngrams import Lexicon, Space, sparse_means
from corpuslab.llm.queries import queries
from tests.llm.tables import ODD_TEXTS, documents, labels, write

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, tmp_path):
    odd = [*ODD_TEXTS, "a b c d a b c", "x x x x", "# $\n# $\n\n \n# $", "a b a b a b", "é* ü|"]
    base = documents(spark, odd).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    write(base, tmp_path)
    write(spark.read.parquet(f"{SF}/labels.parquet"), tmp_path, "labels")
    texts = {r["doc_id"]: r["text"] or "" for r in base.collect()}
    got = queries()["op7_quality_rules"](spark, str(tmp_path)).collect()
    assert len(got) == base.count()
    for r in got:
        n, *rest = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def held_out(rows, key, value):
    return {r["doc_id"]: r[value] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r[key] is not None}


def test_held_out_labels(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    six = queries()["op6_quality_classifier"](spark, SF).collect()
    found = held_out(six, "score", "predicted")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in six)
    hits = [found[k] == truth[k] for k in found if k in truth]
    assert np.mean(hits) >= 0.95
    seven = {r["doc_id"]: r for r in queries()["op7_quality_rules"](spark, SF).collect()}
    judged = [k for k in found if k in truth and not seven[k]["base_failed"]]
    assert np.mean([seven[k]["kept"] == bool(truth[k]) for k in judged]) >= 0.95


@pytest.mark.parametrize("name", ["op6_quality_classifier", "op7_quality_rules"])
def test_without_labels_and_without_rows(spark, tmp_path, name):
    write(documents(spark, [None, "", "word " * 60, " ".join(map(str, range(60)))]), tmp_path)
    write(labels(spark, [(None, 1, 0), (100_000, None, None)]), tmp_path, "labels")
    rows = queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) == 4
    if name.startswith("op6"):
        assert {r["score"] for r in rows} == {0.5}
    else:
        assert [r["kept"] for r in sorted(rows)] == [False, False, False, True]
    write(documents(spark, []), tmp_path)
    assert queries()[name](spark, str(tmp_path)).count() == 0


def test_lexicon_means_are_those_of_the_sparse_rows():
    space = Space(bits=12)
    weights = np.random.default_rng(0).normal(size=space.buckets)
    texts = [b"one two two two three", b"", b"single", "häuser über häuser".encode()]
    lexicon, words = Lexicon(space, weights), [t.split() for t in texts]
    lengths = np.array(list(map(len, words)))
    got = lexicon.means(lexicon.numbers(words), lengths)
    x = sparse_means(texts, space)
    want = [float(s @ weights[b]) if len(b) else 0.0 for b, s in map(x.row, range(len(x)))]
    assert got == pytest.approx(want, abs=1e-5)


def test_calibration_keeps_natural_shares():
    rng = np.random.default_rng(1)
    scores, y = np.concatenate([rng.normal(-1, 1, 400), rng.normal(1, 1, 400)]), np.repeat([0.0, 1.0], 400)
    weight = np.where(y == 1, 0.9, 0.1) / 400 * 800
    slope, shift = quality_rules.calibrate(scores, y, weight)
    p = quality_rules.sigmoid(slope * scores + shift)
    assert np.average(p, weights=weight) == pytest.approx(0.9, abs=0.02)


def test_filters_keep_all_columns(spark):
    docs = documents(spark, ["word " * 10, " ".join(map(str, range(80)))])
    assert quality_rules.keep(docs, None).collect() == docs.filter("doc_id = 100001").collect()


def _some(spark, texts, quality):
    docs = documents(spark, texts)
    return docs, labels(spark, [(100_000 + i, q, 0) for i, q in enumerate(quality)])


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    docs, given = _some(spark, [f"text number {i} of many" for i in range(40)], [i % 2 for i in range(40)])
    docs = docs.unionByName(documents(spark, ["another text"] * 40))  # every id has two texts
    given = given.unionByName(labels(spark, [(100_000 + i, 1 - i % 2, 0) for i in range(10)] + [(100_039, 1, 0)]))  # ten conflicts, one repeated label
    ways = [labelled.sample(docs.orderBy(F.rand(i)), given.orderBy(F.rand(i + 9)), "quality") for i in range(3)]
    assert ways[0] == ways[1] == ways[2]
    assert sorted(r["doc_id"] for r in ways[0]) == list(range(100_010, 100_040))
    assert {r["text"] for r in ways[0]} == {"another text"}
    assert labelled.shares(given, "quality") == (0.5, 0.5)


def test_long_labelled_texts_teach(spark):
    good, bad = "the quiet river runs below the old mill ", "buy cheap pills now click here "
    docs, given = _some(spark, [f"{(good if i % 2 else bad) * 1500}{i}" for i in range(60)], [i % 2 for i in range(60)])
    found = labelled.sample(docs, given, "quality")
    assert len(found) == 60
    assert {len(r["text"]) for r in found} == {labelled.SAMPLE_CHARS}
    assert any(not r["text"].startswith((good[:20], bad[:20])) for r in found)
    model = quality_classifier.fit(docs, given)
    scored = quality_classifier.score(docs, model).join(given, "doc_id").collect()
    assert all((r["score"] >= 0.5) == bool(r["quality"]) for r in scored)


def test_scores_by_brute_force(spark):
    """Scores of operators 6 and 7 from the fitted weights, feature by feature, in plain Python."""
    docs, given = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    six, seven = quality_classifier.fit(docs, given), quality_rules.fit(docs, given)
    texts = [*ODD_TEXTS, *(r["text"] for r in docs.limit(25).collect())]
    own = documents(spark, texts)
    low = (1 << 32) - 1

    def features(text, space):
        bucket = lambda h: (h * 0x9E3779B1 & low) >> (32 - space.bits)
        out, hashes = [], []
        for w in (text or "").encode().split():
            marked = b" " + w + b" "
            h = sum((b + 1) * pow(0x01000193, i + 1, 1 << 32) for i, b in enumerate(marked[:-1])) & low
            hashes.append(h ^ h >> 15)
            out.append(bucket(hashes[-1] ^ 0xA5A5))
            for n in space.sizes:
                for i in range(len(marked) - n + 1):
                    g = marked[i]
                    for b in marked[i + 1 : i + n]:
                        g = (g * 0x01000193 & low) ^ b
                    out.append(bucket(g + n & low))
        for a, b in zip(hashes, hashes[1:], strict=False):
            out.append(bucket(1 if a == b else (a * 0x85EBCA6B + b) & low))
        return out

    got6 = {r["doc_id"]: r["score"] for r in quality_classifier.score(own, six).collect()}
    got7 = {r["doc_id"]: r for r in quality_rules.score(own, seven).collect()}
    for i, text in enumerate(texts):
        if text and len(text) > 20_000:
            continue
        found = features(text, six.space)
        hidden = six.vectors[found].astype(float).mean(axis=0) if found else np.zeros(six.vectors.shape[1])
        logits = hidden @ six.output + six.bias
        assert got6[100_000 + i] == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])), abs=1e-4)
        mean = float(seven.weights[found].astype(float).mean()) if found else 0.0
        p = 1 / (1 + np.exp(-(seven.slope * (mean + seven.bias) + seven.shift)))
        assert got7[100_000 + i]["score"] == pytest.approx(p, abs=1e-4)
        assert got7[100_000 + i]["kept"] == (not got7[100_000 + i]["base_failed"] and got7[100_000 + i]["score"] >= quality_rules.KEEP)


def test_long_and_repeated_texts_with_fitted_models(spark):
    docs, given = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    base = next(r["text"] for r in docs.join(given.filter("quality = 1"), "doc_id").orderBy("doc_id").collect())
    long = (base + "\n") * (2_000_000 // len(base))
    own = documents(spark, [long, long, base, base])
    six = {r["doc_id"]: r["score"] for r in quality_classifier.score(own, quality_classifier.fit(docs, given)).collect()}
    assert six[100_000] == six[100_001]
    assert six[100_002] == six[100_003]
    assert six[100_000] == pytest.approx(six[100_002], abs=0.01)
    seven = {r["doc_id"]: r for r in quality_rules.score(own, quality_rules.fit(docs, given)).collect()}
    assert seven[100_000]["base_failed"]
    assert seven[100_000]["n_words"] == len(long.split())
