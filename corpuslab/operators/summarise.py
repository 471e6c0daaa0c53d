"""Summaries by levels: extractive defaults and roll-ups of any summariser (SUM, CHK-08, UDF-02, UDF-04)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import retrieval

#: A summariser is a column expression over (text, target words); a generator of answers may stand behind a UDF.
Summariser = Callable[[Column, Column], Column]


def first_words(text: Column, target: Column) -> Column:
    """The offline default: the first words, marked where cut."""
    all_words = T.words(F.coalesce(text, F.lit("")))
    return F.when(F.size(all_words) > target, F.concat(F.array_join(F.slice(all_words, F.lit(1), target), " "), F.lit("..."))).otherwise(F.array_join(all_words, " "))


def lead_summary(chunks: DataFrame, keys: Sequence[str], order: str, text: str, target: int = 200, n: int = 5, longest: int = 300) -> DataFrame:
    """SUM-06: the first chunks of a chapter, each cut, then cut to so many words."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    lead = chunks.withColumn("place", place).filter(F.col("place") <= n)
    parts = F.array_sort(F.collect_list(F.struct("place", F.substring(text, 1, longest).alias("t"))))
    joined = lead.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("joined"))
    return joined.select(*keys, F.concat(T.first_words(F.col("joined"), target), F.lit("...")).alias("summary"))


def key_sentences(chunks: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """SUM-06: two sentences each of the first two, middle and last two chunks; of all, up to three."""
    w = Window.partitionBy(*keys)
    at, n = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    half = F.floor(F.col("n") / 2)
    picked = (F.col("n") <= 3) | F.col("at").isin(0, 1) | (F.col("at") == half) | ((F.col("n") > 6) & (F.col("at") == half + 1)) | (F.col("at") >= F.col("n") - 2)
    two = F.array_join(F.slice(F.split(F.trim(text), r"\. "), 1, 2), ". ")
    closed = F.when(two.endswith("."), two).otherwise(F.concat(two, F.lit(".")))
    rows = chunks.withColumn("at", at).withColumn("n", n).filter(picked & (F.trim(text) != ""))
    parts = F.array_sort(F.collect_list(F.struct("at", closed.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("summary"))


def guard_length(text: Column, target: int) -> Column:
    """SUM-07: over 1.3 times the target, cut at the last sentence's end in the last 30 % of 1.2 times, else at the target.

    Shares are compared in tenths, as whole numbers: 0.7 times 90 isn't 63 in floating point.
    """
    w = T.words(text)
    cut = F.array_join(F.slice(w, 1, target * 12 // 10), " ")
    end = F.length(cut) - F.length(F.regexp_extract(cut, r"([^.!?]*)$", 1))
    shorter = F.when((end - 1) * 10 > F.length(cut) * 7, F.substr(cut, F.lit(1), end)).otherwise(F.concat(F.array_join(F.slice(w, 1, target), " "), F.lit("...")))
    return F.when(F.size(w) * 10 > target * 13, shorter).otherwise(text)


def roll_up(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, target: int, summarise: Summariser = first_words) -> DataFrame:
    """SUM-01, SUM-03, SUM-04: one level: texts of a group in order, joined and summarised."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    joined = rows.filter(F.trim(text) != "").groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("joined"), F.count(F.lit(1)).alias("n"))
    return joined.select(*keys, "n", summarise(F.col("joined"), F.lit(target)).alias("summary"))


def three_levels(chunks: DataFrame, section: str, document: str, order: str, text: str, targets: tuple[int, int, int] = (100, 150, 200), summarise: Summariser = first_words) -> dict[str, DataFrame]:
    """SUM-01: chunks, then sections, then documents."""
    low = chunks.select(document, section, order, summarise(F.col(text), F.lit(targets[0])).alias("summary"))
    middle = roll_up(low, [document, section], [order], "summary", targets[1], summarise)
    high = roll_up(middle, [document], [section], "summary", targets[2], summarise)
    return {"chunk": low, "section": middle, "document": high}


def hierarchical(levels: DataFrame, key: str, summarise: Summariser = first_words) -> DataFrame:
    """CHK-08: a summary for each chunk of each level, as long as its level asks for."""
    counts = levels.groupBy(F.col(key).alias("chapter")).agg((F.max("level") + 1).alias("n_levels"))
    held = levels.join(counts, levels[key].eqNullSafe(F.col("chapter"))).withColumn("target_words", T.summary_words(F.col("level"), F.col("n_levels")))
    return held.drop("chapter", "n_levels").withColumn("summary", summarise(F.col("text"), F.col("target_words")))


def fill_missing(units: DataFrame, done: DataFrame, keys: Sequence[str], text: str, target: int, summarise: Summariser = first_words) -> DataFrame:
    """SUM-02, STR-03: summaries of what has none yet."""
    return units.join(done, list(keys), "left_anti").select(*keys, summarise(F.col(text), F.lit(target)).alias("summary"))


def keywords(docs: DataFrame, keys: Sequence[str], text: str, n: int = 5) -> DataFrame:
    """SUM-05: the terms with the largest tf-idf of each group. Terms are counted before they are shuffled."""
    terms = docs.select(*keys, F.explode(retrieval.default_terms(F.col(text))).alias("term")).filter(F.length("term") > 3)
    tf = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.select(*keys).distinct().agg(F.count(F.lit(1)).cast("double").alias("groups"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").join(F.broadcast(total)).withColumn("weight", F.col("tf") * F.log((1 + F.col("groups")) / (1 + F.col("df"))))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "term"))
    return scored.withColumn("place", place).filter(F.col("place") <= n).select(*keys, "place", "term", "tf", "df")


def by_agent(summaries: DataFrame, keys: Sequence[str], agents: Sequence[str], agent: str = "agent", text: str = "summary") -> DataFrame:
    """SUM-09: agents side by side."""
    return summaries.groupBy(*keys).pivot(agent, list(agents)).agg(F.first(text, True))
