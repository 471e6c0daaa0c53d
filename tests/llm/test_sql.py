"""Operators whose rows SQL can state, over whole and odd tables."""

import pytest
from pyspark.sql import functions as F

from corpuslab.llm.queries import oracle_sql, queries
from tests.compare import TABLES, assert_same, connect
from tests.llm.tables import SF, documents, write


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, name, sf):
    assert_same(queries()[name](spark, sf), connect(sf), oracle_sql()[name])


def _view(spark, tmp_path, name, df):
    import duckdb

    write(df, tmp_path, name)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


def test_mixture_of_odd_sources(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (None, "x y", "en", None, 0), (2, "w " * 1000, "en", "b", 0), (3, "w " * 10, "en", "c", 0), (4, "q", "en", "é", 0), (5, "q r", "en", None, 0), (6, "", "en", "z", 0)]
    base = documents(spark, ["a b c"] * 7).unionByName(spark.createDataFrame(rows, documents(spark, []).schema))
    con = _view(spark, tmp_path, "documents", base)
    out = queries()["op10_mix_sources"](spark, str(tmp_path))
    assert_same(out, con, oracle_sql()["op10_mix_sources"])
    assert all(r["taken"] <= 3 * r["size"] for r in out.collect())


def test_mixture_without_ids_and_with_copies(spark, tmp_path):
    """All ids null, one source with a third of all rows, texts repeated as a whole: taken in part, near the target, the same each time."""
    rows = [(None, ("three words here", f"w {i}", f"a longer text number {i}")[i % 3], "en", ("a", "b", None, "c")[i % 7 % 4], 0) for i in range(600)]
    base = spark.createDataFrame(rows, documents(spark, []).schema)
    con = _view(spark, tmp_path, "documents", base)
    query = queries()["op10_mix_sources"]
    out = query(spark, str(tmp_path))
    assert_same(out, con, oracle_sql()["op10_mix_sources"])
    from corpuslab.llm import mixing

    per = mixing.mix(base).groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 2.5 for r in per)
    assert mixing.mix_documents(base).count() == mixing.mix(base).agg({"repetitions": "sum"}).first()[0]
    assert sorted(query(spark, str(tmp_path)).select("size", "taken").collect()) == sorted(out.select("size", "taken").collect())


def test_draws_of_missing_ids_are_spread(spark):
    from corpuslab.llm import mixing

    docs = documents(spark, [f"text {i}" for i in range(3000)]).withColumn("doc_id", F.lit(None).cast("long"))
    sizes = []
    plain = mixing.materialise

    def keep(df, name):
        if name == "sizes":
            sizes.append(df)
        return plain(df, name)

    mixing.materialise = keep
    try:
        mixing.mix(docs).count()
    finally:
        mixing.materialise = plain
    bins = [r["count"] for r in sizes[0].groupBy(F.substring("draw", 1, mixing.BIN_DIGITS)).count().collect()]
    assert max(bins) < 12


def test_mixture_hits_its_targets(spark):
    from corpuslab.llm import mixing

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs)
    per = out.groupBy("source").agg({"target": "max", "taken": "sum", "size": "sum"}).collect()
    for r in per:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.05 * r["max(target)"]
        assert r["max(target)"] <= 3 * r["sum(size)"] * (1 + 1e-9)
    assert sorted(out.collect()) == sorted(mixing.mix(docs).collect())
    taken = {r["doc_id"]: r["repetitions"] for r in out.collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: n for k, n in taken.items() if n}


def test_archives_of_odd_pages(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", "x"), (2, "u", "x"), (2, "u", "x"), (3, None, None), (4, "a\r\nb", ""), (5, "u", "é\r\n\r\nz"), (None, "u", "only"), (6, "u", "long " * 100_000)]
    con = _view(spark, tmp_path, "pages", spark.createDataFrame(rows, schema))
    assert_same(queries()["op2_warc"](spark, str(tmp_path)), con, oracle_sql()["op2_warc"])


def test_searches_of_odd_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 11) % 19) / 19 - 0.5 for j in range(8)], 0) for i in range(210)]
    rows += [(300, None, 0), (350, [nan] * 8, 0), (351, [inf] * 8, 0), (352, [None] * 8, 0), (400, [1.0, 2.0], 0), (401, [3.0, 1.0], 0), (450, [], 0), (None, rows[0][1], 0), (501, rows[0][1], 0), (500, [1e4] * 3, 0), (502, [2e4] * 3, 0)]
    con = _view(spark, tmp_path, "embeddings", spark.createDataFrame(rows, schema))
    assert_same(queries()["op5_topk_search"](spark, str(tmp_path)), con, oracle_sql()["op5_topk_search"])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_empty_tables(spark, tmp_path, name):
    for t in TABLES:
        write(spark.read.parquet(f"{SF}/{t}.parquet").limit(0), tmp_path, t)
    assert queries()[name](spark, str(tmp_path)).count() == 0
