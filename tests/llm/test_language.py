"""Operator 9: gradients by differences, labels by held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuslab.llm import language
from corpuslab.llm.queries import queries
from tests.llm.tables import ODD_TEXTS, documents, write

SF = "/root/testdata/sf0.01"


def test_gradients():
    net = language.new_network(["a", "b", "c"], 4, 1)
    for name in ("inputs", "gates", "candidate", "output", "bias"):
        setattr(net, name, getattr(net, name).astype(float))
    rng = np.random.default_rng(0)
    windows, target = rng.integers(1, 9, (6, 5)), np.array([0, 1, 2, 0, 1])
    windows[4:, 2] = 0
    _, found = language.gradients(net, windows, target)
    for w, g in zip(net.weights(), found, strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if w is net.inputs:
                at = (at[0], int(windows[0, 0]), at[2])
            was, h = w[at], 1e-4  # states are float32
            w[at] = was + h
            up = language.gradients(net, windows, target)[0]
            w[at] = was - h
            down = language.gradients(net, windows, target)[0]
            w[at] = was
            assert abs((up - down) / (2 * h) - g[at]) < 1e-5


def test_padding_changes_nothing():
    net = language.new_network(["a", "b"], 4, 1)
    text = b"some bytes of text"
    alone = language.position_probabilities(net, np.frombuffer(text, np.uint8)[:, None])
    padded = language.position_probabilities(net, np.frombuffer(text + bytes(9), np.uint8)[:, None])
    assert np.allclose(alone, padded[: len(text)], atol=1e-6)


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op9_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.98


def test_odd_texts(spark, tmp_path):
    write(documents(spark, [*ODD_TEXTS, "123 !?", "٣٤", "日本"]).unionByName(spark.read.parquet(f"{SF}/documents.parquet")), tmp_path)
    rows = {r["doc_id"]: r for r in queries()["op9_language_id"](spark, str(tmp_path)).collect()}
    texts = [*ODD_TEXTS, "123 !?", "٣٤", "日本"]
    for i, t in enumerate(texts):
        assert (rows[100_000 + i]["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))


def test_nothing_to_learn(spark, tmp_path):
    write(documents(spark, ["one two", None]).withColumn("lang", F.lit(None).cast("string")), tmp_path)
    assert {(r["lang_pred"], r["score"]) for r in queries()["op9_language_id"](spark, str(tmp_path)).collect()} == {("und", 0.0)}
    write(documents(spark, []), tmp_path)
    assert queries()["op9_language_id"](spark, str(tmp_path)).count() == 0


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "train", lambda texts, languages: sorted(set(languages)))
    rows = [(i, f"text {i}", f"l{i:03}") for i in range(100)]
    found = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert found == [f"l{i:03}" for i in range(100)]


def test_texts_without_a_letter_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(language, "train", lambda texts, languages: sorted(zip(languages, texts, strict=True)))
    rows = [(i, (None, "", "123")[i % 3], "a") for i in range(60)] + [(100, "short", "a"), (101, "brief", "a")]
    found = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), rows=2, chars=20)
    assert found == [("a", b"brief"), ("a", b"short")]


def test_languages_of_long_texts_are_learned(spark, monkeypatch):
    rows = [(i, f"{'the house and the garden ' * 400}{i}", "en") for i in range(60)] + [(i, f"{'das Haus und der Garten ' * 1200}{i}", "de") for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs, F.lit(True))
    assert net.languages == ["de", "en"]
    assert {(r["lang"], r["lang_pred"]) for r in docs.join(language.predict(docs, net), "doc_id").select("lang", "lang_pred").distinct().collect()} == {("en", "en"), ("de", "de")}
    monkeypatch.setattr(language, "train", lambda texts, languages: texts)
    digits = spark.createDataFrame([(1, "1" * 50_000 + "abc", "a")], "doc_id long, text string, lang string")
    assert language.fit(digits, F.lit(True), chars=10) == [b"abc"]


def test_draw_has_the_least_hashes(spark, monkeypatch):
    """The bound of the hash changes nothing: the draw is that of a window over all rows."""
    monkeypatch.setattr(language, "train", lambda texts, languages: sorted(zip(languages, texts, strict=True)))
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CONCAT('text ', id) AS text", "IF(id % 10 = 0, 'b', 'a') AS lang")
    docs = docs.unionByName(docs.limit(0).sparkSession.createDataFrame([(7, "text 7", "a")] * 5 + [(1, "once", "c")] * 900, docs.schema))
    got = language.fit(docs, F.lit(True), rows=50)
    order = [(r["lang"], r["draw"], r["text"]) for r in docs.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("draw")).distinct().collect()]
    want = [(lang, text.encode()) for lang in "abc" for _, _, text in sorted(r for r in order if r[0] == lang)[:50]]
    assert got == sorted(want)


def test_against_the_network_step_by_step(spark):
    """Scores by a plain loop over the fitted weights: one byte and one direction at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    net = language.fit(docs, F.lit(True))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = net.candidate.shape[1]

    def states(window, d):
        state, out = np.zeros(h), []
        for b in window if d == 0 else window[::-1]:
            x = net.inputs[d, b].astype(float)
            r, z = np.split(sigmoid(state @ net.gates[d] + x[: 2 * h]), 2)
            state = state + z * (np.tanh((r * state) @ net.candidate[d] + x[2 * h :]) - state)
            out.append(state)
        return out if d == 0 else out[::-1]

    texts = ["ein Haus im Garten, drei Vögel", "12 le chat noir " * 6]
    got = {r["doc_id"]: r for r in language.predict(documents(spark, texts), net).collect()}
    for i, text in enumerate(texts):
        raw, pooled = text.encode(), []
        for at in range(0, len(raw), language.WINDOW):
            window = raw[at : at + language.WINDOW]
            for b, f, g in zip(window, states(window, 0), states(window, 1), strict=True):
                if b >= 0x80 or chr(b).isalpha():
                    p = np.exp(f @ net.output[0] + g @ net.output[1] + net.bias)
                    pooled.append(p / p.sum())
        p = np.mean(pooled, axis=0)
        r = got[100_000 + i]
        assert r["lang_pred"] == net.languages[int(p.argmax())]
        assert abs(r["score"] - p.max()) < 1e-4
