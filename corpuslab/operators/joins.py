"""Joins with their own meaning: as-of, point in interval, overlap, two-tier, fuzzy, positional (JN)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.fuzzy import sequence_ratio
from corpuslab.session import materialise


def equi_or_default(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """JN-02, JN-03: a left join on a composite key; null or a default on a miss."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def semi(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """JN-04."""
    return left.join(right, list(on), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """JN-05, SET-06."""
    return left.join(right, list(on), "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-06: (key, outcome): matched, left_only or right_only."""
    a, b = left.select(F.col(key), F.lit(1).alias("l")).distinct(), right.select(F.col(key), F.lit(1).alias("r")).distinct()
    outcome = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))


def two_tier(parsed: DataFrame, catalogue: DataFrame, title: str, number: str) -> DataFrame:
    """JN-07: match by exact title, else by normalised title; of catalogue rows with one form the last number counts."""
    exact = catalogue.groupBy(F.trim(title).alias("exact_title")).agg(F.max(number).alias("exact_number"))
    loose = catalogue.groupBy(T.normalise_title(F.col(title)).alias("loose_title")).agg(F.max(number).alias("loose_number"))
    joined = parsed.join(exact, F.trim(parsed[title]) == F.col("exact_title"), "left").join(loose, T.normalise_title(parsed[title]) == F.col("loose_title"), "left")
    return joined.select(*parsed.columns, F.coalesce("exact_number", "loose_number").alias(number), F.when(F.col("exact_number").isNotNull(), "exact").when(F.col("loose_number").isNotNull(), "normalised").alias("tier"))


def heading_context(probes: DataFrame, headings: DataFrame, doc: str, chapter_level: int = 1, least_font: float | None = None) -> DataFrame:
    """JN-09, WIN-13: as-of join. probes (doc, probe_id, position), headings (doc, position, level, text, font_size).

    Both are one stream by position, headings before probes of the same place; the last chapter heading is
    carried forward, and the last section heading since it. Partitioned by document, without a range join.
    """
    is_chapter = (F.col("level") == chapter_level) & (F.lit(True) if least_font is None else F.coalesce(F.col("font_size"), F.lit(0.0)) >= least_font)
    is_section = F.col("level") == chapter_level + 1
    marks = headings.filter(is_chapter | is_section).select(doc, "position", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("probe_id"), F.when(is_chapter, F.col("text")).alias("chapter_text"), F.when(is_section, F.col("text")).alias("section_text"))
    asks = probes.select(doc, "position", F.lit(1).alias("kind"), F.col("probe_id").cast("long").alias("probe_id"), F.lit(None).cast("string").alias("chapter_text"), F.lit(None).cast("string").alias("section_text"))
    so_far = Window.partitionBy(doc).orderBy("position", "kind", F.col("chapter_text").isNull(), "probe_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marks.unionByName(asks).withColumn("chapter", F.last("chapter_text", True).over(so_far)).withColumn("part", F.count("chapter_text").over(so_far))
    in_part = Window.partitionBy(doc, "part").orderBy("position", "kind", F.col("chapter_text").isNull(), "probe_id").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("section", F.last("section_text", True).over(in_part)).filter("kind = 1").select(doc, "probe_id", "position", "chapter", "section")


def page_of(probes: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """JN-10: the page whose half-open interval holds the position, else the document's last page.

    The interval that begins last before the position is found as-of, then tested: no range join.
    """
    starts = pages.select(doc, F.col("start_pos").alias("position"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("probe_id"), F.struct("page_number", "end_pos").alias("page"))
    asks = probes.select(doc, "position", F.lit(1).alias("kind"), F.col("probe_id").cast("long").alias("probe_id"), F.lit(None).cast(starts.schema["page"].dataType).alias("page"))
    so_far = Window.partitionBy(doc).orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(doc)
    found = starts.unionByName(asks).withColumn("at", F.last("page", True).over(so_far)).withColumn("final", F.max(F.struct(F.when(F.col("kind") == 0, F.col("position")), F.col("page.page_number"))).over(whole))
    page = F.when(F.col("position") < F.col("at.end_pos"), F.col("at.page_number")).otherwise(F.coalesce(F.col("final.page_number"), F.lit(1)))
    return found.filter("kind = 1").select(doc, "probe_id", "position", page.alias("page_number"))


def pages_spanned(segments: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """JN-11: pages that overlap [start, end) of each segment (doc, segment_id, start, end); one at least."""
    hit = segments.join(pages.select(doc, "page_number", "start_pos", "end_pos"), doc, "left").withColumn("hit", (F.col("start_pos") < F.col("end")) & (F.col("end_pos") > F.col("start")))
    return hit.groupBy(doc, "segment_id").agg(F.greatest(F.lit(1), F.count_distinct(F.when(F.col("hit"), F.col("page_number")))).alias("n_pages"))


def upper_triangle(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """JN-12: all pairs i < j. Quadratic by meaning: for chapter-level tables, or behind a filter."""
    return left.join(right, F.col(a) < F.col(b))


#: Section titles that name no chapter.
META_HEADINGS = (
    "chapter summaries", "book overview", "overview", "summary", "introduction", "keywords", "appendix", "chapter summaries and collection overview", "book summary", "chapter and book summaries",
    "collection overview", "chapter summaries and overview", "book summaries", "bibliography", "references", "index", "table of contents", "foreword", "preface", "chapter summaries and book overview",
)
LEAST_BODY, SAME_AS_BOOK = 30, 0.75


def chapter_sections(sections: DataFrame, title: str, body: str, book_title: str) -> DataFrame:
    """JN-13: sections that may be chapters: no meta heading, no header of the book, with a body."""
    form = T.match_form(F.col(title))
    own = ~form.isin(*META_HEADINGS) & ~form.rlike(r"^book\s+\d+") & (F.length(body) >= LEAST_BODY)
    return sections.filter(own).filter(sequence_ratio(form, T.match_form(F.col(book_title))) <= SAME_AS_BOOK)


#: Parts into which a block's right titles are dealt, so that a large block is compared by as many tasks.
BLOCK_PARTS = 32


def greedy_pairs(left: DataFrame, right: DataFrame, block: str, a: str, b: str, least: float = 0.45) -> DataFrame:
    """JN-13: fuzzy 1:1 assignment inside each block: best ratio first, each title once. left (block, a), right (block, b).

    A pair that is the best of all that are left for both of its titles is what the sequential choice takes, too, whatever it takes before. So
    rounds take all such pairs at once and drop what shares a title with them, until none is left. Rounds aggregate by title and are
    written to the shared folder; their number is that of the longest chain of pairs in which each is beaten by the next.

    Every pair of a block is a candidate by meaning: the right side is dealt into parts, and a pair whose lengths alone
    keep its ratio below ``least`` isn't compared. Titles repeated in a block are one; null titles and blocks have no pairs;
    of equal ratios the smaller titles go first.
    """
    form = lambda c: T.match_form(F.col(c))
    x = left.select(F.col(block).alias("block"), F.col(a).alias("a")).distinct().withColumn("form_a", form("a"))
    y = right.select(F.col(block).alias("block"), F.col(b).alias("b")).distinct().withColumn("form_b", form("b"))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_PARTS - 1))))
    y = y.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(BLOCK_PARTS)).cast("int"))
    short, both = F.least(F.length("form_a"), F.length("form_b")), F.length("form_a") + F.length("form_b")
    near = x.join(y, ["block", "part"]).filter((both == 0) | (2 * short >= least * both))
    pairs = materialise(near.select("block", "a", "b", sequence_ratio(F.col("form_a"), F.col("form_b")).alias("ratio")).filter(F.col("ratio") >= least), "pairs")
    taken = []
    while not pairs.isEmpty():
        best = lambda own, other: pairs.groupBy("block", own).agg(F.min(F.struct((-F.col("ratio")).alias("ratio"), other))[other].alias(other))  # noqa: B023, E731
        taken.append(materialise(best("a", "b").join(best("b", "a"), ["block", "a", "b"]).join(pairs, ["block", "a", "b"]), "taken"))
        pairs = materialise(pairs.join(taken[-1].select("block", "a"), ["block", "a"], "left_anti").join(taken[-1].select("block", "b"), ["block", "b"], "left_anti"), "pairs")
    out = reduce(DataFrame.unionByName, taken) if taken else pairs
    return out.select(F.col("block").alias(block), F.col("a").alias(a), F.col("b").alias(b), "ratio")


def fuzzy_lookup(titles: DataFrame, index: DataFrame, title: str, target: str) -> DataFrame:
    """JN-14: the index row for each title: exact form, else a prefix either way, else most words in common.

    titles (<title>), index (<target>, position); ties go to the earlier position. The index is a library's
    chapter list; candidates for prefixes and overlaps meet by shared words, not by all pairs.
    """
    left = titles.select(title).distinct().withColumn("form", T.match_form(F.col(title))).withColumn("words", F.array_distinct(F.split("form", " "))).filter("form <> ''")
    right = index.withColumn("key", T.match_form(F.col(target))).filter("key <> ''")
    right = right.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("position"))).filter("place = 1").drop("place").withColumn("key_words", F.array_distinct(F.split("key", " ")))
    shared = left.withColumn("word", F.explode("words")).join(right.withColumn("word", F.explode("key_words")), "word")
    met = shared.groupBy(title, "form", target, "key", "position").agg(F.count(F.lit(1)).alias("overlap"), F.first(F.size("words")).alias("n"))
    prefix = (F.col("key").startswith(F.col("form")) | F.col("form").startswith(F.col("key"))) & (F.length("form") > 10)
    enough = (F.col("n") >= 4) & (F.col("overlap") >= F.least(F.lit(6), F.col("n") - 1))
    tier = F.when(F.col("form") == F.col("key"), 1).when(prefix, 2).when(enough, 3)
    order = Window.partitionBy(title).orderBy("tier", F.when(F.col("tier") == 3, -F.col("overlap")).otherwise(0), "position")
    # a prefix may end inside a word, so that the two share none: those are met by their first ten characters
    near = left.filter(F.length("form") > 10).withColumn("head", F.substring("form", 1, 8)).join(right.withColumn("head", F.substring("key", 1, 8)), "head")
    near = near.filter(prefix).select(title, "form", target, "key", "position", F.lit(0).cast("long").alias("overlap"), F.size("words").alias("n"))
    found = met.unionByName(near).withColumn("tier", tier).filter("tier IS NOT NULL")
    return found.withColumn("place", F.row_number().over(order)).filter("place = 1").select(title, target, "position", "tier")


def by_priority(candidates: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """JN-15: rows of the first tier that has any for the key."""
    tiers = [df.withColumn("tier", F.lit(i)) for i, df in enumerate(candidates)]
    both = tiers[0]
    for other in tiers[1:]:
        both = both.unionByName(other)
    least = F.min("tier").over(Window.partitionBy(*keys))
    return both.withColumn("least", least).filter("tier = least").drop("least")


def issue_key(title: Column) -> Column:
    """JN-16: (volume, issue) of a title like "3(2): ..."."""
    return F.struct(F.regexp_extract(title, r"^\s*(\d+)\s*\((\d+)\)\s*:", 1).try_cast("int").alias("volume"), F.regexp_extract(title, r"^\s*(\d+)\s*\((\d+)\)\s*:", 2).try_cast("int").alias("issue"))


def by_issue(editorials: DataFrame, chapters: DataFrame, chapter_title: str) -> DataFrame:
    """JN-16: editorials (volume, issue, ...) with the chapter that names the same issue; a filled text is kept."""
    keyed = chapters.withColumn("issue_key", issue_key(F.col(chapter_title))).filter("issue_key.volume IS NOT NULL")
    keyed = keyed.select(F.col("issue_key.volume").alias("volume"), F.col("issue_key.issue").alias("issue"), F.col("text").alias("chapter_text"))
    return editorials.join(keyed, ["volume", "issue"], "left").withColumn("text", T.fill_if_empty(F.col("text"), F.col("chapter_text"))).drop("chapter_text")


def zipped(left: DataFrame, right: DataFrame, doc: str, a: str, b: str) -> DataFrame:
    """JN-17: the i-th element of one array with the i-th of another, as far as both go."""
    x = left.select(doc, F.posexplode(a).alias("pos", a))
    y = right.select(doc, F.posexplode(b).alias("pos", b))
    return x.join(y, [doc, "pos"])


def citation_matrix(citations: DataFrame, chapters: DataFrame) -> DataFrame:
    """JN-18: (from_cluster, to_cluster, n): citations to each year, spread over the clusters of that year's chapters."""
    years = chapters.groupBy(F.col("pub_year").alias("cited_year"), F.col("cluster").alias("to_cluster")).agg(F.count(F.lit(1)).alias("m"))
    cites = citations.groupBy(F.col("cluster").alias("from_cluster"), "cited_year").agg(F.count(F.lit(1)).alias("c"))
    return cites.join(years, "cited_year").groupBy("from_cluster", "to_cluster").agg(F.sum(F.col("c") * F.col("m")).alias("n"))


def batches(df: DataFrame, rows: int) -> DataFrame:
    """TOP-11: (batch, n): rows handed on in fixed-size slices, as an embedder would get them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, frame in enumerate(frames):
            yield pd.DataFrame({"batch": range(i * 1_000_000, i * 1_000_000 + -(-len(frame) // rows)), "n": [min(rows, len(frame) - at) for at in range(0, len(frame), rows)]})

    return df.mapInPandas(run, "batch long, n long")
