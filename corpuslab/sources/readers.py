"""Sources of the corpus: catalogue, pages, file names, text and JSON files (SRC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "book_number string, book_name string, book_title string, book_kind string, chapter_number string, author string, chapter_title string, reference string"


def catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-03: (books, chapters) of a positional CSV file: BOM, header, short rows and bad numbers are taken as they come.

    Chapter 0 is the book's row; books that only chapters name get a placeholder; book 0 is left out.
    """
    raw = spark.read.csv(path, schema=CATALOGUE, header=True, enforceSchema=True, mode="PERMISSIVE", multiLine=True)
    whole = lambda c: F.coalesce(F.regexp_replace(F.trim(c), "^﻿", "").try_cast("int"), F.lit(0)).alias(c)
    rows = raw.select(*(whole(c) if c.endswith("_number") else F.coalesce(F.trim(c), F.lit("")).alias(c) for c in raw.columns)).filter("book_number <> 0")
    chapters = rows.filter("chapter_number <> 0").select("book_number", "chapter_number", F.col("chapter_title").alias("title"), "author", "reference")
    own = rows.filter("chapter_number = 0").select("book_number", "book_name", "book_title", F.col("author").alias("book_author"), F.col("reference").alias("book_reference"), "book_kind")
    empty = [F.lit("").alias(c) for c in ("book_name", "book_title", "book_author", "book_reference", "book_kind")]
    placeholders = chapters.select("book_number").distinct().join(own, "book_number", "left_anti").select("book_number", *empty)
    return own.unionByName(placeholders), chapters


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), F.lit(1)), lambda h: html_text(h))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags gone, common entities resolved, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    broken = F.regexp_replace(bare, r"(?i)</?(?:p|br|div|li|h\d|tr|article|footer|nav|ul)\b[^>]*>", "\n")
    plain = F.regexp_replace(broken, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """SRC-04, SRC-05: (key, title, headings, text) of HTML pages, by built-in functions."""
    return pages.select(key, html_title(F.col(html)).alias("title"), html_headings(F.col(html)).alias("headings"), html_text(F.col(html)).alias("text"))


def page_intervals(pages: DataFrame, doc: str, number: str, text: str) -> DataFrame:
    """SRC-04: pages with their half-open character intervals in the document."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(number)
    end = F.sum(F.length(text)).over(w)
    return pages.select(doc, F.col(number).alias("page_number"), (end - F.length(text)).alias("start_pos"), end.alias("end_pos"), F.col(text).alias("text"))


def page_ranges(spark: SparkSession, pages: DataFrame, ranges: list[tuple[int, str, int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """SRC-06: (keys, num, title, text): texts of page ranges, of each document by its keys, from a literal table of (num, title, first, last)."""
    table = spark.createDataFrame(ranges, "num int, title string, first int, last int")
    hit = pages.join(F.broadcast(table), F.col("page_number").between(F.col("first"), F.col("last")))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return hit.groupBy(*keys, "num", "title").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def name_parts(name: Column) -> Column:
    """SRC-07: year, volume, issue and title of a file name; null where it has another form."""
    pattern = r"(?i)^[a-z]+_(\d{4})_v(\d+)_i(\d+)_(.+)\.pdf$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).cast("int").alias("year"), part(2).cast("int").alias("volume"), part(3).cast("int").alias("issue"), F.replace(part(4), F.lit("_"), F.lit(" ")).alias("title")))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """SRC-08: the first row of each key, as a crawl keeps the first article of each DOI."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("place = 1").drop("place")


def looks_like_pdf(content: Column) -> Column:
    """SRC-08: the file's magic number."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def keyed_json(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """SRC-11: a JSON object as a table of its keys and records."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias(key, "record")).select(key, "record.*")


def csv_records(spark: SparkSession, path: str, whole: tuple[str, ...] = ()) -> DataFrame:
    """SRC-12: rows by header, some columns as numbers where they are."""
    df = spark.read.csv(path, header=True)
    return df.withColumns({c: F.col(c).try_cast("long") for c in whole})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-13: blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: name, size and time of files; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("length"), F.col("modificationTime"))
