"""How far the sources of a language differ in their words (operator 12).

1. Each text becomes its distinct terms with their numbers, by sorting its words and cutting the sorted array
   where the word changes (splitting leaves empty strings at a text's ends, which go); a row a distinct term is added up by (lang, source, term) in the tasks and then overall.
2. Each term kept becomes a wide vector: an array with its count in every source of its language, in the order
   of the sources. Totals per source come from the arrays; shares are integers, p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)).
3. Pair contributions are made from a term's array by higher-order functions, a source at a time, so that no row holds
   more than one array; tasks add them up by (lang, source, source) before they are shuffled.
4. Terms that a source has more often than its language has them are ranked; Spark keeps the first ones in each task.

All of it is integers; products that can pass 64 bits are decimals of 38 digits.

Defined cases: null text, lang and source are the empty string; each row is a document, so repeated rows count
each; a language without terms kept has pairs with value 0 and no terms; ties go to the item that comes first in UTF-8; a
very long text is one array of its words; an empty table gives no rows; further columns are not looked at. A side
with the sources of a language is joined, and broadcast only if Spark finds it below its limit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import materialise

#: Terms are runs of ASCII letters and of everything beyond ASCII; between them stand the other ASCII characters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, SMOOTHING = 1_000_000_000, 5


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Where all is ASCII, Spark's faster lower() is the same."""
    return F.when(F.octet_length(text) != F.length(text), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    words = documents.select("lang", "source", F.sort_array(F.split(lower_ascii(F.col("text")), BETWEEN)).alias("words"))
    starts = words.withColumn("starts", F.array_compact(F.transform("words", lambda w, i: F.when((i == 0) | (w != F.get("words", i - 1)), i))))
    runs = F.transform("starts", lambda at, k: F.struct(F.get("words", at).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("words")) - at).alias("n")))
    each = starts.select("lang", "source", F.explode(runs).alias("run")).select("lang", "source", "run.term", "run.n").filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), exactly."""
    number = (count + SMOOTHING).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", number, (total + SMOOTHING * kept).cast("decimal(28,0)")) + 1


def wide_vectors(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, sources, kept, totals) a language, and (lang, term, counts, shares, overall) a term kept; arrays in the order of sources."""
    docs = documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sources = docs.select("lang", "source").distinct().groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    sources = materialise(sources, "sources")
    numbered = sources.select("lang", F.posexplode("sources").alias("i", "source"))
    cells = term_counts(docs).join(numbered, ["lang", "source"])
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("i", "n")).alias("cells")).filter(F.col("docs") >= least)
    terms = terms.withColumn("by_source", F.map_from_entries("cells")).join(sources, "lang")
    counts = F.transform("sources", lambda s, i: F.coalesce(F.try_element_at("by_source", i), F.lit(0).cast("long")))
    wide = materialise(terms.select("lang", "term", counts.alias("counts")), "wide")
    totals = wide.select("lang", F.posexplode("counts").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kept"))
    totals = totals.groupBy("lang").agg(F.max("kept").alias("kept"), F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("totals"))
    zeros = F.transform("sources", lambda s: F.lit(0).cast("long"))
    langs = materialise(
        sources.join(totals, "lang", "left").select("lang", "sources", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("totals", zeros).alias("totals")), "langs"
    )
    plus = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, c: a + c)
    shares = F.transform("counts", lambda c, i: share(c, F.get("totals", i), F.col("kept")))
    scored = wide.join(langs, "lang").select("lang", "term", "counts", shares.alias("shares"), share(plus("counts"), plus("totals"), F.col("kept")).alias("overall"))
    return langs, materialise(scored, "shares")


def _contributions(rows: DataFrame, values: Column, apart) -> DataFrame:
    """(lang, i, j, value), i < j: apart(value of i, value of j) for each pair of places of an array."""
    each = rows.select("lang", values.alias("values")).select("lang", "values", F.posexplode("values").alias("i", "own"))
    rest = F.transform(F.slice("values", F.col("i") + 2, F.size("values")), lambda other, k: F.struct((F.col("i") + 1 + k).alias("j"), apart(F.col("own"), other).alias("value")))
    return each.select("lang", "i", F.explode(rest).alias("pair")).select("lang", "i", "pair.j", "pair.value")


def source_pairs(langs: DataFrame, scored: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources: absolute differences of shares, added up."""
    none = _contributions(langs, F.col("totals"), lambda a, b: F.lit(0).cast("long"))
    some = _contributions(scored, F.col("shares"), lambda a, b: F.abs(a - b))
    summed = some.unionByName(none).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = summed.join(langs.select("lang", "sources"), "lang").select("lang", "sources", "value", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("to"))
    return both.select("lang", F.get("sources", F.col("to.a")).alias("source"), F.get("sources", F.col("to.b")).alias("item"), "value")


def source_terms(langs: DataFrame, scored: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a source has more often than its language, the first ``top``."""
    over = F.filter(F.transform("counts", lambda n, i: F.struct(i.alias("i"), n.alias("n"), (F.get("shares", i) - F.col("overall")).alias("value"))), lambda x: (x["n"] > 0) & (x["value"] > 0))
    each = scored.select("lang", F.col("term").alias("item"), F.explode(over).alias("x")).select("lang", "item", "x.i", "x.value")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    return ranked.join(langs.select("lang", "sources"), "lang").select("lang", F.get("sources", F.col("i")).alias("source"), "item", "value", "rank")


def audit(documents: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` against every other source of the language, ``term`` the terms over-used."""
    langs, scored = wide_vectors(documents, least)
    pairs = source_pairs(langs, scored).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = pairs.withColumn("part", F.lit("pair")).unionByName(source_terms(langs, scored, top).withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", "rank")


#: The same rows in DuckDB SQL, for terms in at least 30 documents and 50 ranks.
ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
words AS (
  SELECT lang, source, r, unnest(words) AS term FROM docs),
kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sources AS (
  SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT s.lang, s.source, k.term, z.v, coalesce(c.n, 0) AS n
  FROM sources s JOIN kept k ON s.lang = k.lang JOIN sizes z ON z.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
totals AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own_total, sum(n) OVER (PARTITION BY lang) AS lang_total, sum(n) OVER (PARTITION BY lang, term) AS lang_n FROM cells),
shares AS (
  SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 5) // (own_total + 5 * v) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (lang_n + 5) // (lang_total + 5 * v) AS BIGINT) AS q
  FROM totals),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
