"""Scalar functions, on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import fuzzy
from corpuslab.functions import text as T
from corpuslab.functions import vectors as V


def values(spark, items, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("x")).alias("y")).collect())]


def test_word_count(spark):
    assert values(spark, ["", "  ", "a  b", None], T.word_count) == [0, 0, 2, 0]


def test_tokens_round_half_to_even(spark):
    assert values(spark, ["a " * 5, "a"], T.token_estimate) == [6, 1]


def test_approx_page(spark):
    df = spark.createDataFrame([(0, 100, 10), (99, 100, 10), (5, 0, 10)], "o int, l int, p int")
    assert [r[0] for r in df.select(T.approx_page(F.col("o"), F.col("l"), F.col("p"))).collect()] == [1, 10, 0]


def test_years(spark):
    assert values(spark, ["X. (2006a). T", "X. (1999). T", "none"], T.year_of) == [2006, 1999, None]
    assert values(spark, ["X. (2006a). T", "X. (1999). T"], lambda c: T.year_of(c, suffix=False)) == [None, 1999]


def test_titles(spark):
    assert values(spark, ["Chapter IV. Foo's Bar by Jane Doe", "12. Deep  Thought", "Mix: of things"], T.normalise_title) == ["foos bar", "deep thought", "of things"]
    assert values(spark, ["Introduction", "Introduction to X", "Notes on Y", "Ch 1 ..... 4", "Acknowledgments", "Author’s Biography", "A Chapter"], T.is_excluded_title) == [True, False, True, True, True, True, False]
    assert values(spark, ["Introduction to X"], T.is_legacy_excluded_title) == [True]


def test_small_ones(spark):
    assert values(spark, ["3. Heading"], T.strip_number) == ["Heading"]
    assert values(spark, ["see 10.1000/xyz.12,"], T.doi) == ["10.1000/xyz.12"]
    assert values(spark, ["no doi"], T.doi) == [None]
    assert values(spark, ["Ann Lee1,2 · Bo Chen3"], T.strip_superscripts) == ["Ann Lee,2 · Bo Chen"]
    assert values(spark, ["A · B & C,, D"], T.join_authors) == ["A, B, C, D"]
    assert values(spark, ["iv", "XXX", "x y"], T.roman_value) == [4, 30, None]
    assert values(spark, ["A: b/c  d?"], T.safe_filename) == ["A_bc_d"]
    assert values(spark, ["make", "the", "beautiful", "rhythm"], T.syllables) == [1, 1, 3, 1]
    assert values(spark, ["Keywords: a b; c, d."], T.keyword_list) == [["a b", "c", "d"]]
    assert values(spark, ["one <two>\n\n*three*"], T.html_paragraphs) == ["<p>one &lt;two&gt;</p>\n<p><em>three</em></p>"]
    assert values(spark, ["  ", None, "x"], lambda c: T.fill_if_empty(c, F.lit("d"))) == ["d", "d", "x"]


def test_html_paragraphs_lose_blanks_only(spark):
    assert values(spark, ["0 10\n\n 1 at 1 \n \n2.2", "", None], T.html_paragraphs) == ["<p>0 10</p>\n<p>1 at 1</p>\n<p>2.2</p>", "", None]


def test_summary_words(spark):
    df = spark.createDataFrame([(0, 2), (1, 2), (0, 4), (3, 4)], "l int, n int")
    assert [r[0] for r in df.select(T.summary_words(F.col("l"), F.col("n"))).collect()] == [100, 200, 50, 200]


@pytest.mark.parametrize(
    ("tail", "expected"),
    [
        ("A title. In X (Ed.), Y.", ("A title", "chapter")),
        ("A title. MIT Press.", ("A title", "monograph")),
        ("A title. Some Journal.", ("A title", "article_or_other")),
        ("Only a title", ("Only a title", "unknown")),
    ],
)
def test_references(spark, tail, expected):
    row = spark.range(1).select(T.parse_reference(F.lit(f"Ander, G. (2006). {tail}"), F.lit(2006)).alias("p")).first()["p"]
    assert tuple(row) == expected


def test_ratio_and_sentences(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.sequence_ratio("a", "b")).collect()] == [0.75, None]
    assert fuzzy.split_sentences("Dr. Smith came. He left! Was it G. Miller? Yes.") == ["Dr. Smith came.", "He left!", "Was it G. Miller?", "Yes."]
    assert fuzzy.split_sentences("  ") == []


def test_header():
    assert fuzzy.parse_header("Volume 3\nA study of\ngroups at work\nAnn Lee1 · Bo Chen2\nText") == {"title": "A study of groups at work", "authors": "Ann Lee, Bo Chen"}


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [3.0, 4.0])], "k string, v array<double>")
    means = {r["k"]: r["centroid"] for r in V.mean_vectors(df, ["k"], "v").collect()}
    assert means == {"a": [0.5, 0.5], "b": [3.0, 4.0]}
    assert df.filter("k = 'b'").select(V.unit(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])
    assert df.select(V.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0)))).first()[0] is None


def test_a_batch_stems_each_word_once(spark):
    """Nulls, empty lists and slices of a batch keep their places."""
    from corpuslab.functions import stemming

    import pyarrow as pa

    lists = pa.array([["never"], ["running", "dogs", "running"], None, [], ["dogs"]], pa.list_(pa.string()))
    assert stemming.stems.func(lists.slice(1)).to_pylist() == [["run", "dog", "run"], None, [], ["dog"]]
    seen, before = [], stemming.stem
    stemming.stem = lambda w: seen.append(w) or before(w)
    try:
        stemming.stems.func(lists)
    finally:
        stemming.stem = before
    assert sorted(seen) == ["dogs", "never", "running"]
    assert values(spark, [["dogs", "dogs"], None], stemming.stems, "array<string>") == [["dog", "dog"], None]


def test_texts_are_python_objects_a_piece_at_a_time(spark, monkeypatch):
    """An Arrow column of many values is worked on in pieces; embeddings likewise, in the embedder's batches."""
    import numpy as np
    import pyarrow as pa

    from corpuslab.functions import fuzzy
    from corpuslab.operators import chunking, reports

    sizes = []

    class Column:
        def __init__(self, column):
            self.column = column

        def __len__(self):
            return len(self.column)

        def slice(self, at, n):
            sizes.append(len(self.column.slice(at, n)))
            return self.column.slice(at, n)

    column = pa.array([f"Book Overview\n-----\n{i}" for i in range(600)] + [None, ""])
    assert reports.overview.func(Column(column)).to_pylist() == [*map(str, range(600)), "", ""]
    assert fuzzy.sentences.func(Column(column[:0])).to_pylist() == []
    assert max(sizes) == fuzzy.PIECE and sum(sizes) == 602

    class Sized:
        def embed_texts(self, texts):
            return np.full((len(texts), 2), len(texts))

    docs = spark.createDataFrame([(i, "x" if i else None) for i in range(25)], "doc_id long, text string").coalesce(1)
    got = chunking.embed(docs, ["doc_id"], embedder=Sized(), batch=10)
    assert got.dtypes == [("doc_id", "bigint"), ("embedding", "array<float>")]
    assert [r["embedding"][0] for r in got.orderBy("doc_id").collect()] == [10.0] * 20 + [5.0] * 5
