"""Citations of one author's works: extraction, reference entries, resolution (CIT, FN-15, JN-14..15)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions import vectors as V
from corpuslab.operators import joins
from corpuslab.operators.filters import YEARS

SNIPPET_AROUND = 80


def patterns(surname: str) -> tuple[str, str, str, str]:
    """Author first, narrative, parenthesis with the author, author inside it."""
    return (
        rf"\b{surname}(?:\s+et\s+al\.?|\s+&\s+[^,()]{{1,40}})?,\s*(\d{{4}}[a-z]?)\b",
        rf"\b{surname}\s+\((\d{{4}}[a-z]?)\b",
        rf"\(([^()]*\b{surname}\b[^()]*)\)",
        rf"\b{surname}[^,()]{{0,40}},\s*(\d{{4}}[a-z]?)\b",
    )


def inline_citations(text: str | None, surname: str, compat: bool = False) -> list[dict]:
    """CIT-01, SET-04: one row for each place and year, in the order of the patterns.

    ``compat`` counts citations inside parentheses twice, as offsets that leave the bracket out did.
    """
    first, narrative, broad, inner = (re.compile(p) for p in patterns(surname))
    text = text or ""
    found = [(m.start(), m[1]) for p in (first, narrative) for m in p.finditer(text)]
    found += [(m.start() + (0 if compat else 1) + i.start(), i[1]) for m in broad.finditer(text) for i in inner.finditer(m[1])]
    out, seen = [], set()
    for start, cited in found:
        year = int(cited[:4])
        if YEARS[0] <= year <= YEARS[1] and (start, year) not in seen:
            seen.add((start, year))
            snippet = text[max(0, start - SNIPPET_AROUND) : start + SNIPPET_AROUND].replace("\n", " ").strip()
            out.append({"start": start, "cited_year": year, "suffix": cited[4:], "snippet": snippet})
    return out


def extract(chunks: DataFrame, keys: Sequence[str], surname: str, text: str = "text", compat: bool = False) -> DataFrame:
    """CIT-02: chunks to citations. Texts without the name are filtered in the JVM before Python sees any."""
    rows = chunks.filter(F.contains(F.col(text), F.lit(surname))).select(*keys, text)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", start int, cited_year int, suffix string, snippet string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(*row[:-1], *c.values()) for row in frame.itertuples(index=False, name=None) for c in inline_citations(row[-1], surname, compat)]
            yield pd.DataFrame(found, columns=[*keys, "start", "cited_year", "suffix", "snippet"])

    return rows.mapInPandas(run, schema)


def years_cited(chunks: DataFrame, keys: Sequence[str], surname: str, text: str = "text") -> DataFrame:
    """CIT-02 for counts: (keys, cited_year) of author-first citations, by built-in functions alone."""
    years = F.regexp_extract_all(F.col(text), F.lit(patterns(surname)[0]), F.lit(1))
    return chunks.select(*keys, F.explode(years).alias("cited")).select(*keys, F.substring("cited", 1, 4).cast("int").alias("cited_year")).filter(F.col("cited_year").between(*YEARS))


def reference_entries(chunks: DataFrame, keys: Sequence[str], surname: str, initial: str = "G", text: str = "text") -> DataFrame:
    """CIT-03: all entries (keys, year, line) of the author's reference lines, once: resolution joins by year."""
    line = F.explode(F.split(text, "\n")).alias("line")
    entry = rf"(?i)^.{{0,15}}{surname},\s*{initial}\..*?\((\d{{4}}[a-z]?)\)\.\s*.+"
    lines = chunks.select(*keys, line).select(*keys, F.trim("line").alias("line"))
    return lines.withColumn("year", F.regexp_extract("line", entry, 1)).filter("year <> ''").select(*keys, "year", "line")


REASONS = ("no_ref_list_in_book", "year_not_in_ref_list", "ambiguous_year", "cited_whole_book", "apa_parse_failed", "cited_article_not_in_library", "chapter_title_not_in_library")


def resolve(citations: DataFrame, chunks: DataFrame, library: DataFrame, surname: str, initial: str = "G") -> DataFrame:
    """CIT-04: citations (citation_id, book, chapter, cited_year) against the reference lists of chunks (book, chapter, text)
    and the chapters of the library (title, position, to_book, to_chapter).

    Entries of the chapter count before those of the book (JN-15). The first reason that holds is given, in order.
    """
    entries = reference_entries(chunks, ["book", "chapter"], surname, initial).select("book", "chapter", "year", "line").distinct()
    asked = citations.select("citation_id", "book", "chapter", F.col("cited_year").cast("string").alias("year"))
    own = asked.join(entries, ["book", "chapter", "year"]).select("citation_id", "line", F.lit("chapter").alias("ref_source"))
    any_chapter = asked.join(entries.drop("chapter").distinct(), ["book", "year"]).select("citation_id", "line", F.lit("book").alias("ref_source"))
    matched = joins.by_priority([own, any_chapter], ["citation_id"]).groupBy("citation_id").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.first("ref_source").alias("ref_source"))
    listed = chunks.filter(F.col("text").rlike(rf"(?i){surname},\s*{initial}\.?\s*\(\d{{4}}[a-z]?\)")).select("book").distinct().withColumn("has_list", F.lit(True))
    one = asked.join(matched, "citation_id", "left").join(listed, "book", "left").withColumn("entry", F.when(F.size("lines") == 1, F.col("lines")[0]))
    parsed = one.withColumn("parsed", T.parse_reference(F.col("entry"), F.col("year"))).withColumn("apa_title", F.col("parsed.title")).withColumn("to_type", F.when(F.col("entry").isNotNull(), F.col("parsed.type")))
    hits = joins.fuzzy_lookup(parsed.filter("apa_title <> ''"), library, "apa_title", "title")
    hit_rows = hits.select(F.col("apa_title").alias("hit_title"), "title", "position").join(library.select("position", "to_book", "to_chapter"), "position")
    joined = parsed.join(hit_rows, F.col("apa_title") == F.col("hit_title"), "left")
    found, kind = F.col("to_chapter").isNotNull(), F.col("to_type")
    reason = (
        F.when(F.col("lines").isNull(), F.when(F.col("has_list"), "year_not_in_ref_list").otherwise("no_ref_list_in_book"))
        .when(F.size("lines") > 1, "ambiguous_year")
        .when(kind == "monograph", "cited_whole_book")
        .when(kind.isin("article_or_other", "unknown") & (F.coalesce("apa_title", F.lit("")) == ""), "apa_parse_failed")
        .when((kind == "article_or_other") & ~found, "cited_article_not_in_library")
        .when(~found, "chapter_title_not_in_library")
    )
    joined = joined.withColumn("unresolved_reason", reason)
    entry = F.when(F.size("lines") > 1, F.array_join(F.slice("lines", 1, 3), " | ")).otherwise(F.col("entry"))
    keep = lambda c: F.when(F.col("unresolved_reason").isNull(), F.col(c)).alias(c)
    return joined.select("citation_id", "book", "chapter", F.col("year").alias("cited_year"), F.col("unresolved_reason").isNull().alias("resolved"), "ref_source", entry.alias("to_apa_entry"), "to_type", keep("to_book"), keep("to_chapter"), "unresolved_reason")


def citation_vectors(pairs: DataFrame, vectors: DataFrame, chapter: str, vector: str = "embedding") -> DataFrame:
    """CIT-05: pairs (citation_id, vec_id, to_chapter) with the citing vector, the cited chapter's mean and their sum."""
    means = V.mean_vectors(vectors, [chapter], vector, "to_vector").withColumnRenamed(chapter, "to_chapter")
    citing = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("from_vector"))
    joined = pairs.join(citing, "vec_id").join(means, "to_chapter")
    return joined.withColumn("sum_vector", V.add(F.col("from_vector"), F.col("to_vector")))


def diagnostics(resolved: DataFrame, samples: int = 30) -> DataFrame:
    """CIT-06, AGG-22, AGG-23: the most frequent entries of each reason."""
    counted = resolved.groupBy("unresolved_reason", "to_apa_entry").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("unresolved_reason").orderBy(F.desc("n"), "to_apa_entry"))
    return counted.withColumn("place", place).filter(F.col("place") <= samples)
