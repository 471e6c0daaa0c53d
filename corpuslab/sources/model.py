"""Schemas of the corpus tables and how older files are read as them (D1..D21, SRC-01, SRC-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

SUMMARY = "struct<author:string,date:string,prompt:string,number_of_words:int,text:string>"
SCHEMAS = {
    "books": f"book_number int, book_name string, book_title string, book_author string, book_keywords array<string>, book_reference string, book_text string, book_number_of_pages int, book_kind string, book_summaries array<{SUMMARY}>",
    "chapters": f"book_number int, chapter_number int, title string, author string, keywords array<string>, reference string, text string, pages int, words int, tokens int, symbols int, summaries array<{SUMMARY}>",
    "chunks": "chunk_index int, book_number int, chapter_number int, page_number int, text string, section_heading string, level int, start_offset int, end_offset int, word_count int, token_count int",
    "vectors": "vector_id bigint, embedding array<float>, book_number int, chapter_number int, chunk_index int, chunk_level int, chunk_page int, chunk_start int, chunk_end int, chunk_words int, book_title string, chapter_title string",
    "editorials": f"year int, volume int, issue int, title string, author string, words int, text string, summary {SUMMARY}, summary_second {SUMMARY}, summary_book {SUMMARY}, pdf string",
    "query_history": "id int, timestamp string, user string, question string, retrieval_query string, answer string, model string, embedding array<float>",
    "headings": "text string, level int, page int, position int, font_size double",
    "pages": "page_number int, start_pos int, end_pos int, text string",
}


def schema(name: str) -> ST.StructType:
    return ST.StructType.fromDDL(SCHEMAS[name])


def evolve(df: DataFrame, target: ST.StructType, renamed: dict[str, str] | None = None) -> DataFrame:
    """§1.3: any older table as the target schema: old names, missing columns as null, types cast where they can be."""
    old = {new: was for was, new in (renamed or {}).items()}

    def column(f: ST.StructField):
        found = [F.col(c) for c in (f.name, old.get(f.name)) if c in df.columns]
        value = F.coalesce(*found) if found else F.lit(None)
        return (value.try_cast(f.dataType) if isinstance(f.dataType, ST.AtomicType) else value.cast(f.dataType)).alias(f.name)

    return df.select(*map(column, target.fields))


def load(spark: SparkSession, path: str, name: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """SRC-01, SRC-02, SRC-09..11, SRC-14: a table from Parquet, by its schema."""
    return evolve(spark.read.parquet(path), schema(name), renamed)


def with_sentinels(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Nulls inside, sentinels only on the way out."""
    return df.na.fill(values)
