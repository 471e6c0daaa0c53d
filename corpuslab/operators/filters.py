"""Filters with a rule of their own (FLT) and audits over them (AGG-26, AGG-27)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T

#: Plausible years, clusters that are left out of timelines, narrative words at least.
YEARS = (1970, 2030)
NOISE_CLUSTERS = (6, 12)
MIN_NARRATIVE_WORDS, MIN_CHAPTER_WORDS, MIN_LEGACY_WORDS = 50, 100, 1000
#: Signs of a reference-list line, and lines and share from which a chunk is a bibliography.
REFERENCE_SIGN = r"(?i)(?:\([12]\d{3}[/,\-a-z\d]*\)|pp\.\s*\d+|Vol\.\s*\d+|\bdoi:|\bPress\b)"
MIN_REFERENCE_LINES, MAX_REFERENCE_SHARE = 4, 0.5


def levels(chunks: DataFrame, wanted: Sequence[int] | None) -> DataFrame:
    """FLT-01, FLT-02: chunks of these levels; None: of all."""
    return chunks if wanted is None else chunks.filter(F.col("level").isin(*wanted))


def content_chapters(chapters: DataFrame) -> DataFrame:
    """FLT-03."""
    return chapters.filter("chapter_number > 0")


def with_vector(rows: DataFrame) -> DataFrame:
    """FLT-04."""
    return rows.filter("vector_id IS NOT NULL")


def plausible_year(year: Column) -> Column:
    """FLT-05."""
    return year.between(*YEARS)


def in_timeline(cluster: Column, excluded: Sequence[int] = NOISE_CLUSTERS) -> Column:
    """FLT-06."""
    return ~cluster.isin(*excluded)


def substantial(text: Column, least: int = MIN_CHAPTER_WORDS) -> Column:
    """FLT-09, FLT-11."""
    return T.word_count(text) >= least


def chapter_heading(level: int, least_font: float | None, allowed: DataFrame | None = None):
    """FLT-10: headings (doc, text, level, font_size) that open chapters; allowed (doc, allowed_title) are let through."""

    def keep(headings: DataFrame) -> DataFrame:
        sentence = F.trim("text").endswith(".") & (F.length(F.trim("text")) > 50)
        font = F.lit(True) if least_font is None else F.coalesce(F.col("font_size"), F.lit(0.0)) >= least_font
        rows = headings.filter((F.col("level") == level) & font & ~sentence)
        if allowed is None:
            return rows.filter(~T.is_excluded_title(F.col("text")))
        # the allow-list is configuration: a few rows a book
        known = rows.join(F.broadcast(allowed), (rows.doc == allowed.doc) & (F.lower(F.trim(rows.text)) == allowed.allowed_title), "left")
        return known.filter(F.col("allowed_title").isNotNull() | ~T.is_excluded_title(rows.text)).select(*(rows[c] for c in rows.columns))

    return keep


def is_bibliography(text: Column) -> Column:
    """FLT-12: four lines or more, over half of them like references."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    hits = F.filter(lines, lambda x: x.rlike(REFERENCE_SIGN))
    return (F.size(lines) >= MIN_REFERENCE_LINES) & (F.size(hits) / F.size(lines) > MAX_REFERENCE_SHARE)


def is_empty(column: Column, kind: str) -> Column:
    """FLT-14: null, blank, zero or without elements, by type."""
    if kind == "string":
        return column.isNull() | (F.trim(column) == "")
    if kind.startswith(("array", "map")):
        return column.isNull() | (F.size(column) == 0)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return column.isNull() | (column == 0)
    return column.isNull()


def is_question(text: Column) -> Column:
    """FLT-15: input that is neither blank nor a session command."""
    return (F.trim(text) != "") & ~F.lower(F.trim(text)).isin("quit", "exit", "q", "clear")


def structural_title(title: Column) -> Column:
    """FLT-16."""
    return T.is_structural_title(title)


def heading_like(text: Column, font_size: Column) -> Column:
    """FLT-17: not overlong, not a mere sign, not in small print."""
    return (F.length(text) <= 150) & (F.length(F.trim(text)) > 2) & (font_size >= 13)


def empty_slots(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-26: (keys, field) for each empty field: one pass, no union."""
    checked = [c for c in rows.columns if c not in keys]
    names = F.array_compact(F.array(*(F.when(is_empty(F.col(c), dict(rows.dtypes)[c]), F.lit(c)) for c in checked)))
    return rows.select(*keys, F.explode(names).alias("field"))


def funnel(chunks: DataFrame, text: str, narrative: str) -> DataFrame:
    """AGG-27: one row of counters. Words are counted both before and after short chunks go."""
    words, biblio = T.word_count(F.col(narrative)), is_bibliography(F.col(text))
    short = ~biblio & (words < MIN_NARRATIVE_WORDS)
    kept = ~biblio & ~short
    return chunks.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(biblio).alias("excluded_biblio"), F.count_if(short).alias("excluded_short"), F.count_if(kept).alias("kept"),
        F.sum(T.word_count(F.col(text))).alias("words_original"), F.sum(F.when(~biblio, words)).alias("words_narrative"), F.sum(F.when(kept, words)).alias("words_kept"),
    )
