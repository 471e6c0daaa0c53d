"""Aggregates, windows and set operations of the corpus analyses (AGG, WIN, SET).

Ranks always have a partition key or follow a limit; every order ends in a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions import vectors as V


def ranked_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG-01, AGG-06, AGG-07, AGG-23."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def totals(chapters: DataFrame, book: str, *measures: str) -> DataFrame:
    """AGG-02: sums a book and, with a null book, of the library."""
    return chapters.rollup(book).agg(*(F.sum(m).alias(m) for m in measures))


def level_stats(chunks: DataFrame, level: str, text: str) -> DataFrame:
    """AGG-03: count, mean, least and most characters, mean words, as whole numbers."""
    n = F.length(text)
    return chunks.groupBy(level).agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.avg(n)).alias("mean_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.floor(F.avg(T.word_count(F.col(text)))).alias("mean_words")
    )


def plurality(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """AGG-04, AGG-05: the most frequent value of each group; of equals, the one seen first by order."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return ranked_within(counted, keys, [F.desc("n"), F.col("first"), F.col(value)], 1).drop("place", "first")


def share_of_year(counts: DataFrame, year: str = "year", n: str = "n") -> DataFrame:
    """AGG-08, WIN-12: per cent of the year's total, one decimal; 0.0 where the total is 0."""
    total = F.sum(n).over(Window.partitionBy(year))
    return counts.withColumn("pct", F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.col(n) / total, 1)))


def pivot_years(counts: DataFrame, clusters: Sequence, year: str = "year", cluster: str = "cluster", n: str = "n") -> DataFrame:
    """AGG-09: a row for each year, a column for each cluster, 0 where there is nothing."""
    return counts.groupBy(year).pivot(cluster, list(clusters)).sum(n).na.fill(0)


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-10: counts of pairs with both marginals and the total (nulls), and their log1p."""
    grouped = rows.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return grouped.withColumn("log_n", F.round(F.log1p("n"), 6))


def bubble_sizes(rows: DataFrame, cluster: str, x: str, y: str, full: int = 320, least: int = 14) -> DataFrame:
    """AGG-11: counts scaled to the largest of their cluster."""
    counted = count_by(rows, cluster, x, y)
    return counted.withColumn("size", F.greatest(F.lit(float(least)), F.col("n") / F.max("n").over(Window.partitionBy(cluster)) * full))


def span_summary(rows: DataFrame, cluster: str, published: str, cited: str) -> DataFrame:
    """AGG-12."""
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{c}") for c in (published, cited) for name, f in (("min", F.min), ("max", F.max))))


def nested_timeline(rows: DataFrame, cluster: str, published: str, cited: str, n: int = 10, without_year: int = 8) -> DataFrame:
    """AGG-13: per cluster and year, the most cited years as "y(c), ..."; rows without a year have a bucket of their own."""
    counted = count_by(rows, cluster, published, cited)
    top = ranked_within(counted, [cluster, published], [F.desc("n"), F.col(cited)], n).filter(F.col(published).isNotNull() | (F.col("place") <= without_year))
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat(F.col(cited).cast("string"), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("s"))))
    return top.groupBy(cluster, published).agg(F.concat_ws(", ", F.transform(listed, lambda p: p["s"])).alias("cited"))


def top_bars(rows: DataFrame, value: str, n: int = 25, width: int = 35) -> DataFrame:
    """AGG-14: the most frequent values, each with a bar. The window sees n rows."""
    counted = count_by(rows, value).orderBy(F.desc("n"), value).limit(n)
    most = F.max("n").over(Window.partitionBy())
    return counted.withColumn("bar", F.repeat(F.lit("█"), F.greatest(F.lit(1), F.round(F.col("n") / most * width).cast("int"))))


def cluster_stats(vectors: DataFrame, cluster: str = "label", vector: str = "embedding") -> DataFrame:
    """AGG-15: size, mean cosine distance to the unit centroid, and this over the mean of all rows."""
    centroids = V.mean_vectors(vectors, [cluster], vector).select(cluster, V.unit(F.col("centroid")).alias("centroid"))
    # a row for each cluster
    distances = vectors.join(F.broadcast(centroids), cluster).select(cluster, (1 - V.dot(F.col(vector), F.col("centroid"))).alias("distance"))
    per = distances.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), F.sum("distance").alias("total"))
    everything = Window.partitionBy()
    return per.withColumn("breadth", F.col("mean_distance") / (F.sum("total").over(everything) / F.sum("n").over(everything))).drop("total")


def exemplars(vectors: DataFrame, n: int = 5, cluster: str = "label", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """TOP-04, CLU-03: the rows nearest to each cluster's centroid."""
    centroids = V.mean_vectors(vectors, [cluster], vector).select(cluster, V.unit(F.col("centroid")).alias("centroid"))
    scored = vectors.join(F.broadcast(centroids), cluster).withColumn("similarity", V.dot(F.col(vector), F.col("centroid")))
    return ranked_within(scored, [cluster], [F.desc("similarity"), F.col(key)], n).select(cluster, "place", key, "similarity")


def joined_texts(chunks: DataFrame, keys: Sequence[str], order: str, text: str, first: Sequence[str] = ()) -> DataFrame:
    """AGG-18: texts of a chapter in order, their words and number, and first-seen metadata."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(*keys).agg(
        F.concat_ws("\n\n", F.transform(parts, lambda p: p[text])).alias("text"), F.sum(T.word_count(F.col(text))).alias("words"), F.count(F.lit(1)).alias("n_chunks"), *(F.min_by(c, order).alias(c) for c in first)
    )


def conditional_counts(rows: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """AGG-20: rows of each group under each condition, and whether there is any."""
    aggs = [f for name, c in conditions.items() for f in (F.count_if(c).alias(f"n_{name}"), F.bool_or(F.coalesce(c, F.lit(False))).alias(f"any_{name}"))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def share_like(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """AGG-21: per cent of rows that match."""
    return rows.agg(F.round(100 * F.avg(F.col(text).rlike(pattern).cast("int")), 2).alias("pct"))


def outcome_histogram(rows: DataFrame, outcome: str) -> DataFrame:
    """AGG-22: counts and per cent of all; a row for each outcome."""
    return count_by(rows, outcome).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def early_and_late(rows: DataFrame, year: str, metrics: Sequence[str], early: tuple[int, int] = (1967, 1984), late: tuple[int, int] = (2016, 2026)) -> DataFrame:
    """AGG-24: (metric, early, late, delta)."""
    means = rows.agg(*(F.avg(F.when(F.col(year).between(*span), F.col(m))).alias(f"{m}_{name}") for m in metrics for name, span in (("early", early), ("late", late))))
    items = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_early").alias("early"), F.col(f"{m}_late").alias("late")) for m in metrics)))
    return means.select(items.alias("x")).select("x.metric", "x.early", "x.late", (F.col("x.late") - F.col("x.early")).alias("delta"))


def global_means(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """AGG-25."""
    return rows.agg(*(F.avg(m).alias(m) for m in metrics))


def small_chapters(chunks: DataFrame, chapter: str, words: str, least: int = 100) -> DataFrame:
    """AGG-28: rows of chapters with fewer words in total."""
    return chunks.withColumn("chapter_words", F.sum(words).over(Window.partitionBy(chapter))).filter(F.col("chapter_words") < least)


def book_overview(chapters: DataFrame, book: str, chapter: str, page: str, words: str) -> DataFrame:
    """AGG-29."""
    return chapters.groupBy(book).agg(F.count_distinct(chapter).alias("chapters"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.sum(words).alias("words"))


def median_by(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """AGG-30."""
    return rows.groupBy(cluster).agg(F.median(value).alias("median"))


def box_numbers(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """AGG-31: quartiles, and the farthest values within 1.5 interquartile ranges of them."""
    given = rows.filter(F.col(value).isNotNull())
    q = given.groupBy(cluster).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(cluster, *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = given.join(F.broadcast(q), cluster).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(cluster).agg(F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min(value).alias("low"), F.max(value).alias("high"))


def adjacent_similarity(chunks: DataFrame, doc: str, order: str, vector: str) -> DataFrame:
    """WIN-02: cosine of each chunk with the next of its chapter; null for the last."""
    following = F.lead(vector).over(Window.partitionBy(doc).orderBy(order))
    return chunks.select(doc, order, V.cosine(F.col(vector), following).alias("next_similarity"))


def runs(rows: DataFrame, doc: str, order: str, linked: Column) -> DataFrame:
    """WIN-03 without a cap: a run goes on while a row is linked to the one before; adds run."""
    return rows.withColumn("run", F.sum((~F.coalesce(linked, F.lit(False))).cast("int")).over(Window.partitionBy(doc).orderBy(order)))


def rolling_mean(rows: DataFrame, keys: Sequence[str], year: str, value: str, around: int = 2, least: int = 2) -> DataFrame:
    """WIN-04: centred mean over rows, not years; null for fewer than ``least`` rows."""
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(-around, around)
    return rows.withColumn("rolling", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def segments(headings: DataFrame, doc: str, length: Column) -> DataFrame:
    """WIN-05: each heading's text ends where the next begins, the last at the end of the text."""
    return headings.withColumn("end", F.coalesce(F.lead("position").over(Window.partitionBy(doc).orderBy("position")), length))


def merge_split_headings(headings: DataFrame, doc: str) -> DataFrame:
    """WIN-06: consecutive headings of one page, level and size (within half a point of the run's first) become one.

    The comparison is with the run's first row, so the run is folded over the document's ordered headings.
    """
    item = F.struct("position", "text", "level", "page", "font_size")
    ordered = F.array_sort(F.collect_list(item))

    def step(done: Column, h: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["page"] == h["page"]) & (F.try_element_at(done, F.lit(-1))["level"] == h["level"]) & (F.abs(F.try_element_at(done, F.lit(-1))["font_size"] - h["font_size"]) < 0.5)
        text = F.when(F.endswith(last["text"], F.lit("-")), F.concat(F.substr(last["text"], F.lit(1), F.length(last["text"]) - 1), h["text"])).otherwise(F.concat(last["text"], F.lit(" "), h["text"]))
        merged = F.struct(last["position"].alias("position"), text.alias("text"), last["level"].alias("level"), last["page"].alias("page"), last["font_size"].alias("font_size"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(h)))

    grouped = headings.groupBy(doc).agg(ordered.alias("hs"))
    empty = F.slice(F.col("hs"), 1, 0)
    return grouped.select(doc, F.inline(F.aggregate("hs", empty, step)))


def merge_continuations(headings: DataFrame, doc: str) -> DataFrame:
    """WIN-07: a heading that goes on in lower case on the same or next page, in like size, joins the one before; pairwise.

    A row joins if it could and the row before it didn't: in a chain of such rows, every second one.
    """
    w = Window.partitionBy(doc).orderBy("position")
    before = lambda c: F.lag(c).over(w)
    could = F.coalesce((F.col("page") <= before("page") + 1) & F.col("text").rlike(r"^\p{Ll}") & (F.abs(F.col("font_size") - before("font_size")) < 2.0), F.lit(False))
    chained = headings.withColumn("could", could).withColumn("chain", F.sum((~F.col("could")).cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy(doc, "chain").orderBy("position"))
    joined = chained.withColumn("joins", place % 2 == 0).withColumn("tail", F.lead("text").over(w)).withColumn("takes", F.coalesce(F.lead("joins").over(w), F.lit(False)))
    text = F.when(F.col("takes"), F.concat(F.col("text"), F.when(F.col("text").endswith("-"), "").otherwise(" "), F.col("tail"))).otherwise(F.col("text"))
    return joined.withColumn("text", text).filter(~F.col("joins")).drop("could", "chain", "joins", "tail", "takes")


def collapse_parts(headings: DataFrame, doc: str) -> DataFrame:
    """WIN-08: "Part X", a subtitle and "Introduction to Part X" become one heading at the first one's place."""
    w = Window.partitionBy(doc).orderBy("position")
    one, two = F.lead("text", 1).over(w), F.lead("text", 2).over(w)
    opens = F.col("text").rlike(r"^Part\s+(?:[IVXivx]+|\d+)\s*$") & F.coalesce(two.rlike(r"^Introduction\s+to\s+Part\s+(?:[IVXivx]+|\d+)\s*$"), F.lit(False))
    marked = headings.withColumn("opens", opens).withColumn("one", one).withColumn("two", two)
    taken = F.coalesce(F.lag("opens", 1).over(w), F.lit(False)) | F.coalesce(F.lag("opens", 2).over(w), F.lit(False))
    text = F.when(F.col("opens"), F.concat(F.trim("two"), F.lit(": "), F.trim("one"))).otherwise(F.col("text"))
    return marked.withColumn("taken", taken).filter(~F.col("taken")).withColumn("text", text).drop("opens", "one", "two", "taken")


def carried_headings(lines: DataFrame, doc: str, is_heading: Column) -> DataFrame:
    """WIN-13: each line with the last heading above it."""
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(is_heading, F.col("line")), True).over(w)).filter(~is_heading)


def next_ids(new: DataFrame, old: DataFrame, key: str, order: str, bins: int = 256) -> DataFrame:
    """WIN-14: ids that go on behind the largest so far, by a numeric order.

    Rows are numbered inside bins of the order and start behind the rows of the bins before, so that no task
    sees them all. Bins are cut at approximate percentiles; where the cuts lie doesn't change the ids.
    """
    last = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    cuts = new.agg(F.percentile_approx(order, [i / bins for i in range(1, bins)], 1000)).first()[0] or []
    bin_of = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    binned = new.withColumn("bin", F.when(F.col(order).isNull(), -1).otherwise(bin_of))
    before = F.sum("rows").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    # at most one row a bin
    starts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("rows")).select("bin", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = binned.join(F.broadcast(starts), "bin").withColumn(key, F.row_number().over(Window.partitionBy("bin").orderBy(order)) + F.col("before") + F.lit(last))
    return numbered.drop("bin", "before")


def year_marks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], year: str) -> DataFrame:
    """WIN-15: whether a row's year differs from the one before."""
    before = F.lag(year).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("new_year", ~F.col(year).eqNullSafe(before))


def all_years(*frames: DataFrame, year: str = "year") -> DataFrame:
    """SET-01."""
    both = frames[0].select(year)
    for other in frames[1:]:
        both = both.union(other.select(year))
    return both.distinct()


def unique_in_order(items: Column) -> Column:
    """SET-02, SET-08."""
    return F.array_distinct(items)


def common_words(a: Column, b: Column) -> Column:
    """SET-03."""
    return F.size(F.array_intersect(F.array_distinct(a), b))


def stacked(rows: DataFrame, keys: Sequence[str], agents: Sequence[str], text: str = "text") -> DataFrame:
    """SET-07: a column for each agent becomes a row for each, blank ones left out."""
    items = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.col(a).alias(text)) for a in agents)))
    return rows.select(*keys, items.alias("x")).select(*keys, "x.agent", f"x.{text}").filter(F.trim(text) != "")


def nulls_last(rows: DataFrame, *columns: str) -> DataFrame:
    """TOP-09: ascending by several keys, missing ones behind."""
    return rows.orderBy(*(F.asc_nulls_last(c) for c in columns))
