"""Every query and stage over tables with extra columns whose names the operators use themselves, and nulls in all of theirs."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm.queries import queries
from tests.llm.tables import SF, documents, write

CLASHING = "size source_size target taken repetitions bin draw take_id take_n take_copy place kept_key label label_id score kept node tile family keys ids width rank start license paragraph lang_pred held_out digest largest".split()


def widened(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("wide")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    nothing = spark.createDataFrame([(None, None, None, None, None)], base.schema)
    write(widened(base.unionByName(nothing).unionByName(documents(spark, ["", None]))), path)
    for name, key in (("labels", "doc_id"), ("pages", "page_id"), ("embeddings", "vec_id")):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        empty = table.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields))
        write(widened(table.unionByName(empty)), path, name)
        assert key in table.columns
    return str(path)


@pytest.fixture(scope="module")
def narrow(spark, wide, tmp_path_factory):
    """The same rows without the extra columns."""
    path = tmp_path_factory.mktemp("narrow")
    for name in ("documents", "labels", "pages", "embeddings"):
        write(spark.read.parquet(f"{wide}/{name}.parquet").select(*spark.read.parquet(f"{SF}/{name}.parquet").columns), path, name)
    return str(path)


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows_with_extra_columns(spark, wide, narrow, name):
    got, plain = queries()[name](spark, wide), queries()[name](spark, narrow)
    assert got.columns == plain.columns
    rows = sorted(map(repr, plain.collect()))
    assert rows
    assert sorted(map(repr, got.collect())) == rows


def test_stages_keep_all_columns(spark, wide):
    docs = spark.read.parquet(f"{wide}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, wide).cache()
        assert docs.columns == columns
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, wide).count() == docs.count()
