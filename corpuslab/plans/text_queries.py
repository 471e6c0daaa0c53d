"""Text functions, cleaning, style, chunking, citations, reports and sources over documents, pages and conversations.

Regular expressions that SQL states too keep to what both engines read alike (ASCII classes, no look-around).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import analytics as A
from corpuslab.operators import sentences as boundaries
from corpuslab.operators import chunking, citations, clean, joins, reports, style, summarise
from corpuslab.plans.registry import Registry, table, texts
from corpuslab.sources import readers

registry = Registry()
query = registry.query

#: A citation that the tables lack, made of the id in both engines.
_CITED = "'(Ander, ' || CAST(1990 + doc_id % 30 AS VARCHAR) || ') ' || text"
_RATES = "hedge_per_1k assert_per_1k causal_per_1k contrast_per_1k additive_per_1k exemplify_per_1k i_per_1k we_per_1k passive_per_1k semicolon_per_1k citation_per_1k subordinate_per_1k".split()


def _docs(spark, sf_dir):
    return texts(spark, sf_dir)


def _cited(spark, sf_dir):
    years = (F.lit(1990) + F.col("doc_id") % 30).cast("string")
    return _docs(spark, sf_dir).withColumn("text", F.concat(F.lit("(Ander, "), years, F.lit(") "), F.col("text")))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS words, CAST(round_even(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) * 1.3::DOUBLE, 0) AS BIGINT) AS tokens FROM documents")
def word_and_token_counts(spark, sf_dir):
    """FN-01, FN-02, AGG-33."""
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(CASE WHEN n_chars = 0 THEN 0 ELSE 1 + floor((n_chars // 2)::DOUBLE / n_chars * (1 + n_chars // 1800)) END AS BIGINT) AS page FROM documents")
def approximate_pages(spark, sf_dir):
    """FN-03."""
    n = F.col("n_chars")
    return _docs(spark, sf_dir).select("doc_id", T.approx_page(F.floor(n / 2), n, 1 + F.floor(n / 1800)).alias("page"))


@query("SELECT doc_id, TRY_CAST(substr(regexp_extract(ref, '\\((\\d{4}[a-z]?)\\)', 1), 1, 4) AS INTEGER) AS year, CASE WHEN doc_id % 3 = 0 THEN 'chapter' WHEN doc_id % 5 = 0 THEN NULL ELSE 'book' END AS year_source FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'X. (' || 1980 + doc_id % 40 || 'a). T' WHEN doc_id % 5 = 0 THEN 'none' ELSE 'Y. (' || 1970 + doc_id % 40 || '). T' END AS ref FROM documents)")
def reference_years(spark, sf_dir):
    """FN-04, FN-05, PRJ-04: the chapter's year, else the book's, and where it is from."""
    n = F.col("doc_id")
    chapter = F.when(n % 3 == 0, F.concat(F.lit("X. ("), (1980 + n % 40).cast("string"), F.lit("a). T"))).otherwise("none")
    book = F.when(n % 5 == 0, "none").otherwise(F.concat(F.lit("Y. ("), (1970 + n % 40).cast("string"), F.lit("). T")))
    year, source = T.year_with_source(chapter, book)
    return _docs(spark, sf_dir).select("doc_id", year.alias("year"), source.alias("year_source"))


@query("SELECT doc_id, trim(regexp_replace(lower(replace(text, '''', '')), '[^0-9a-z_]+', ' ', 'g')) AS form FROM documents")
def title_forms(spark, sf_dir):
    """FN-07, FN-08 in ASCII."""
    return _docs(spark, sf_dir).select("doc_id", T.ascii_match_form(F.replace("text", F.lit("'"), F.lit(""))).alias("form"))


@query("SELECT doc_id, regexp_replace(title, '^\\d+\\.\\s*', '') AS bare, title LIKE '%..........%' OR k IN (0, 1) AS excluded FROM (SELECT doc_id, doc_id % 4 AS k, CASE doc_id % 4 WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Notes on Y' WHEN 2 THEN '12. Chapter of ' || lang ELSE 'Ch ' || doc_id || ' .......... 4' END AS title FROM documents)")
def excluded_titles(spark, sf_dir):
    """FLT-07, FN-09."""
    n = F.col("doc_id")
    title = F.when(n % 4 == 0, "Introduction").when(n % 4 == 1, "Notes on Y").when(n % 4 == 2, F.concat(F.lit("12. Chapter of "), "lang")).otherwise(F.concat(F.lit("Ch "), n.cast("string"), F.lit(" .......... 4")))
    return _docs(spark, sf_dir).select("doc_id", T.strip_number(title).alias("bare"), T.is_excluded_title(title).alias("excluded"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')[1:10], ' ') AS head FROM documents")
def first_ten_words(spark, sf_dir):
    """FN-19, SNK-02."""
    return _docs(spark, sf_dir).select("doc_id", T.first_words(F.col("text"), 10).alias("head"))


@query("SELECT doc_id, trim(replace(substr(text, 1, 220), chr(10), ' ')) AS cut, trim(replace(substr(text, greatest(1, 100 - 80), 100 + 80 - greatest(1, 100 - 80)), chr(10), ' ')) AS around FROM documents")
def snippets(spark, sf_dir):
    """PRJ-02, FN-26."""
    return _docs(spark, sf_dir).select("doc_id", T.excerpt(F.col("text"), 220).alias("cut"), T.snippet(F.col("text"), F.lit(100)).alias("around"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM documents")
def file_sizes(spark, sf_dir):
    """FN-30."""
    return _docs(spark, sf_dir).select("doc_id", T.file_size(F.col("n_chars")).alias("size"))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]{2,}')) AS w FROM documents), l AS (SELECT doc_id, lower(w) AS w FROM t), c AS (SELECT doc_id, w, count(*) AS n FROM l GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapax, CAST(sum(n * length(w)) AS BIGINT) AS chars, CAST(coalesce(sum(n) FILTER (regexp_matches(w, '(tion|ity|ness|ment|ism|ance|ence|ivity)$')), 0) AS BIGINT) AS abstract FROM c GROUP BY doc_id""")
def vocabulary_counts(spark, sf_dir):
    """STY-03's counts, FN-21 without marks."""
    tokens = F.regexp_extract_all("text", F.lit("[a-zA-Z]{2,}"), F.lit(0))
    low = F.col("low")
    rows = _docs(spark, sf_dir).select("doc_id", F.array_sort(F.transform(tokens, F.lower)).alias("low")).filter(F.size(low) > 0)
    return rows.select(
        "doc_id", F.size(low).cast("long").alias("tokens"), F.size(F.array_distinct(low)).cast("long").alias("types"), style.hapax(low).cast("long").alias("hapax"),
        F.aggregate(low, F.lit(0).cast("long"), lambda s, t: s + F.length(t)).alias("chars"), F.size(F.filter(low, lambda t: t.rlike(style.ABSTRACT))).cast("long").alias("abstract"),
    )


@query("SELECT doc_id, CAST(sum(greatest(1, len(regexp_extract_all(CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy]e$') THEN substr(w, 1, length(w) - 1) ELSE w END, '[aeiouy]+')))) AS BIGINT) AS syllables FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z]{2,}'))) AS w FROM documents) GROUP BY doc_id")
def syllable_counts(spark, sf_dir):
    """FN-20, for STY-02."""
    tokens = F.regexp_extract_all("text", F.lit("[a-zA-Z]{2,}"), F.lit(0))
    total = F.aggregate(F.transform(tokens, T.syllables), F.lit(0).cast("long"), lambda s, x: s + x)
    return _docs(spark, sf_dir).filter(F.size(tokens) > 0).select("doc_id", total.alias("syllables"))


def _rate_sql() -> str:
    def one(name: str) -> str:
        pattern = style.RATES[name].replace("'", "''")
        return f"CASE WHEN w > 0 THEN round(len(regexp_extract_all(text, '{pattern}')) / (w / 1000.0::DOUBLE), 3) ELSE 0 END AS {name}"

    # letters beyond ASCII count as one plain letter, so that word boundaries are the same for both engines
    return "SELECT doc_id, " + ", ".join(map(one, _RATES)) + " FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::DOUBLE AS w FROM documents)"


@query(_rate_sql())
def style_rates(spark, sf_dir):
    """STY-04..09, as far as SQL's expressions have no look-around."""
    words, plain = T.word_count(F.col("text")), F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    docs = _docs(spark, sf_dir).select("doc_id", words.alias("words"), plain.alias("plain"))
    return docs.select("doc_id", *(style.per_1k(F.col("plain"), F.col("words"), name).alias(name) for name in _RATES))


@query()
def style_features(spark, sf_dir):
    """STY-10: all 31 metrics a document."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", T.word_count(F.col("text")).alias("words"))
    return style.features(docs).drop("text")


@query()
def cleaned_texts(spark, sf_dir):
    """TXT-10, FLT-11."""
    cleaned = clean.clean(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", cleaned.alias("narrative_text")).withColumn("narrative_words", T.word_count(F.col("narrative_text"))).filter("narrative_words >= 50")


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS text FROM documents")
def normalised_space(spark, sf_dir):
    """TXT-09."""
    return _docs(spark, sf_dir).select("doc_id", clean.normalise_space(F.col("text")).alias("text"))


@query()
def chunked_documents(spark, sf_dir):
    """CHK-01, CHK-02."""
    return chunking.chunk_texts(_docs(spark, sf_dir), ["doc_id"])


@query()
def chunk_hierarchy(spark, sf_dir):
    """CHK-03..07: conversations as chapters, their messages as chunks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("chunk_index"), F.col("text"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"))
    return chunking.build_hierarchy(rows, "conv_id")


@query(f"SELECT doc_id, CAST(1990 + doc_id % 30 AS INTEGER) AS cited_year FROM (SELECT doc_id, {_CITED} AS text FROM documents) WHERE contains(text, 'Ander')")
def citations_extracted(spark, sf_dir):
    """CIT-01, CIT-02, SET-04, TRAP-08: each citation once, though two patterns see it."""
    return citations.extract(_cited(spark, sf_dir), ["doc_id"], "Ander").select("doc_id", "cited_year")


@query(f"SELECT doc_id, CAST(substr(c, 1, 4) AS INTEGER) AS cited_year FROM (SELECT doc_id, unnest(regexp_extract_all({_CITED}, '\\bAnder(?:\\s+et\\s+al\\.?|\\s+&\\s+[^,()]{{1,40}})?,\\s*(\\d{{4}}[a-z]?)\\b', 1)) AS c FROM documents) WHERE CAST(substr(c, 1, 4) AS INTEGER) BETWEEN 1970 AND 2030")
def citation_years(spark, sf_dir):
    """CIT-02 for counts, all in the JVM."""
    return citations.years_cited(_cited(spark, sf_dir), ["doc_id"], "Ander")


@query("SELECT doc_id, CASE k WHEN 0 THEN 'First part' WHEN 1 THEN 'Deep work' ELSE 'Some study' END AS title, CASE k WHEN 0 THEN 'chapter' WHEN 1 THEN 'monograph' ELSE 'article_or_other' END AS type FROM (SELECT doc_id, doc_id % 3 AS k FROM documents)")
def parsed_references(spark, sf_dir):
    """FN-15."""
    n, year = F.col("doc_id"), 1990 + F.col("doc_id") % 30
    tail = F.when(n % 3 == 0, "First part. In X (Ed.), Y.").when(n % 3 == 1, "Deep work. MIT Press.").otherwise("Some study. Journal of Things, 3.")
    entry = F.concat(F.lit("Ander, G. ("), year.cast("string"), F.lit("). "), tail)
    return _docs(spark, sf_dir).select("doc_id", T.parse_reference(entry, year).alias("p")).select("doc_id", "p.title", "p.type")


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'year_not_in_ref_list' WHEN doc_id % 4 = 2 THEN 'cited_whole_book' ELSE 'cited_article_not_in_library' END AS unresolved_reason, count(*) AS n FROM documents GROUP BY 1")
def citations_resolved(spark, sf_dir):
    """CIT-03, CIT-04, JN-14, JN-15, AGG-22: every document is a book with a reference list of one entry."""
    n = F.col("doc_id")
    year = (1990 + n % 30).cast("string")
    tail = F.when(n % 4 == 0, "A study of groups at work. In X (Ed.), Y.").when(n % 4 == 2, "Deep work. MIT Press.").otherwise("Some quite unknown study. Journal of Things, 3.")
    listed = F.when(n % 4 == 1, F.lit("1971")).otherwise(year)
    chunks = _docs(spark, sf_dir).select(n.alias("book"), F.lit(1).alias("chapter"), F.concat(F.lit("Text.\nAnder, G. ("), listed, F.lit("). "), tail).alias("text"))
    asked = _docs(spark, sf_dir).select(n.alias("citation_id"), n.alias("book"), F.lit(1).alias("chapter"), year.cast("int").alias("cited_year"))
    library = spark.createDataFrame([("A Study of Groups at Work", 1, 7, 2), ("Another chapter", 2, 7, 3)], "title string, position int, to_book int, to_chapter int")
    return A.count_by(citations.resolve(asked, chunks, library, "Ander"), "unresolved_reason")


@query("""
WITH h AS (SELECT doc_id, unnest([0, 40, 80, 120]) AS position FROM documents), p AS (SELECT doc_id, unnest([10, 50, 95, 130]) AS position, unnest([0, 1, 2, 3]) AS probe_id FROM documents)
SELECT doc_id, probe_id, position, CASE WHEN position < 80 THEN 'H0' ELSE 'H80' END AS chapter, CASE WHEN position BETWEEN 40 AND 79 THEN 'S40' WHEN position >= 120 THEN 'S120' END AS section FROM p""")
def asof_heading(spark, sf_dir):
    """JN-09: a new chapter resets the section."""
    docs = _docs(spark, sf_dir).select("doc_id")
    heads = F.explode(F.array(*(F.struct(F.lit(p).alias("position"), F.lit(lv).alias("level"), F.lit(t).alias("text"), F.lit(20.0).alias("font_size")) for p, lv, t in ((0, 1, "H0"), (40, 2, "S40"), (80, 1, "H80"), (120, 2, "S120"))))).alias("h")
    probes = F.posexplode(F.array(*map(F.lit, (10, 50, 95, 130)))).alias("probe_id", "position")
    return joins.heading_context(docs.select("doc_id", probes), docs.select("doc_id", heads).select("doc_id", "h.*"), "doc_id").withColumn("probe_id", F.col("probe_id").cast("int"))


@query("SELECT doc_id, probe_id, position, CAST(CASE WHEN position >= n_chars THEN greatest(1, ceil(n_chars / 500.0)) ELSE position // 500 + 1 END AS INTEGER) AS page_number FROM (SELECT doc_id, n_chars, unnest([0, 499, 500, 100000000]) AS position, unnest([0, 1, 2, 3]) AS probe_id FROM documents WHERE n_chars > 0)")
def interval_page(spark, sf_dir):
    """JN-10, SRC-04: pages of 500 characters."""
    docs = _docs(spark, sf_dir).filter("n_chars > 0").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    pages = docs.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(500))).alias("i", "start_pos"))
    pages = pages.select("doc_id", (F.col("i") + 1).alias("page_number"), "start_pos", F.least(F.col("start_pos") + 500, F.col("n")).alias("end_pos"))
    probes = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, (0, 499, 500, 100000000)))).alias("probe_id", "position"))
    return joins.page_of(probes, pages, "doc_id").withColumn("probe_id", F.col("probe_id").cast("int"))


@query("""
SELECT doc_id, i AS segment_id, greatest(1, CAST((least(1200 * (i + 1), n_chars) - 1) // 500 - (1200 * i) // 500 + 1 AS BIGINT)) AS n_pages
FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars + 1199) // 1200)) AS i FROM documents WHERE n_chars > 0)""")
def pages_spanned(spark, sf_dir):
    """JN-11: pages of 500 characters under each segment of 1,200."""
    docs = _docs(spark, sf_dir).filter("n_chars > 0").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    pages = docs.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(500))).alias("i", "start_pos"))
    pages = pages.select("doc_id", (F.col("i") + 1).alias("page_number"), "start_pos", F.least(F.col("start_pos") + 500, F.col("n")).alias("end_pos"))
    segments = docs.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1200))).alias("i", "start"))
    segments = segments.select("doc_id", F.col("i").cast("long").alias("segment_id"), "start", F.least(F.col("start") + 1200, F.col("n")).alias("end"))
    return joins.pages_spanned(segments, pages, "doc_id").select("doc_id", "segment_id", F.col("n_pages").cast("long").alias("n_pages"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l QUALIFY length(line) >= 40""")
def carried_headings(spark, sf_dir):
    """WIN-13, SRC-15: short lines as headings."""
    lines = reports.lines_of(_docs(spark, sf_dir), "doc_id", "text")
    return A.carried_headings(lines, "doc_id", F.length("line") < 40).select("doc_id", "line_no", "heading")


@query("""
WITH l AS (SELECT doc_id, length(text) AS n, unnest(list_filter([1, 500, 1000], lambda x: x <= length(text))) AS position FROM documents)
SELECT doc_id, position, CAST(coalesce(lead(position) OVER (PARTITION BY doc_id ORDER BY position), n) AS INTEGER) AS "end" FROM l""")
def segment_ends(spark, sf_dir):
    """WIN-05."""
    docs = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"))
    heads = docs.select("doc_id", "n", F.explode(F.array(*map(F.lit, (1, 500, 1000)))).alias("position")).filter("position <= n")
    return A.segments(heads, "doc_id", F.col("n")).select("doc_id", "position", "end")


@query("SELECT doc_id, list_distinct_in_order AS names FROM (SELECT doc_id, (SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT w, min(i) AS p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) GROUP BY w)) AS list_distinct_in_order FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS ws FROM documents))")
def unique_in_order(spark, sf_dir):
    """SET-02, SET-08."""
    names = A.unique_in_order(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    return _docs(spark, sf_dir).select("doc_id", F.nullif(F.array_join(names, " "), F.lit("")).alias("names"))


@query("SELECT doc_id, agent, text FROM (SELECT doc_id, 'lang' AS agent, lang AS text FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) WHERE trim(text) <> ''")
def stacked_agents(spark, sf_dir):
    """SET-07."""
    return A.stacked(_docs(spark, sf_dir), ["doc_id"], ["lang", "source"])


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?is)<h[12][^>]*>.*?</h[12]>')) AS INTEGER) AS n_headings FROM pages")
def parsed_pages(spark, sf_dir):
    """SRC-04, SRC-05."""
    return readers.parse_pages(texts(spark, sf_dir, "pages")).select("page_id", "title", F.size("headings").alias("n_headings"))


@query("""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|br|div|li|h\\d|tr|article|footer|nav|ul)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '[\\s\\v]*\\n[\\s\\v]*', chr(10), 'g'), ' ') AS text FROM c)
SELECT page_id, text, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS words FROM d""")
def page_texts(spark, sf_dir):
    """SRC-05: visible text of each page."""
    return readers.parse_pages(texts(spark, sf_dir, "pages")).select("page_id", "text", T.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, CAST(regexp_extract(name, '_(\\d{4})_v', 1) AS INTEGER) AS year, CAST(regexp_extract(name, '_v(\\d+)_', 1) AS INTEGER) AS volume, CAST(regexp_extract(name, '_i(\\d+)_', 1) AS INTEGER) AS issue, CAST(year - 2005 AS INTEGER) AS volume_of_year FROM (SELECT doc_id, 'journal_' || (2006 + doc_id % 20) || '_v' || (1 + doc_id % 20) || '_i' || (1 + doc_id % 4) || '_a_title.pdf' AS name FROM documents)")
def file_name_parts(spark, sf_dir):
    """SRC-07, FN-29."""
    n = F.col("doc_id")
    name = F.concat(F.lit("journal_"), (2006 + n % 20).cast("string"), F.lit("_v"), (1 + n % 20).cast("string"), F.lit("_i"), (1 + n % 4).cast("string"), F.lit("_a_title.pdf"))
    return _docs(spark, sf_dir).select("doc_id", readers.name_parts(name).alias("p")).select("doc_id", "p.year", "p.volume", "p.issue", T.volume_of(F.col("p.year")).alias("volume_of_year"))


@query("SELECT conv_id, string_agg(substr(text, 1, 300), ' ' ORDER BY turn) AS joined FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5) GROUP BY conv_id")
def lead_texts(spark, sf_dir):
    """SUM-06: the material of the extractive summary, uncut."""
    return _lead(table(spark, sf_dir, "conversations"))


def _lead(rows):
    top = A.ranked_within(rows, ["conv_id"], [F.col("turn")], 5)
    parts = F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, 300).alias("t"))))
    return top.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("joined"))


@query("""
WITH l AS (SELECT conv_id, string_agg(substr(text, 1, 300), ' ' ORDER BY turn) AS joined FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5) GROUP BY conv_id)
SELECT conv_id, array_to_string(regexp_extract_all(joined, '[^ \\t\\n\\r\\f\\v]+')[1:40], ' ') || '...' AS summary FROM l""")
def lead_summaries(spark, sf_dir):
    """SUM-06."""
    return summarise.lead_summary(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", target=40)


@query("""
WITH l AS (SELECT lang, source, string_agg(array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')[1:100], ' '), chr(10) || chr(10) ORDER BY doc_id) AS joined, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1, 2),
w AS (SELECT *, regexp_extract_all(joined, '[^ \\t\\n\\r\\f\\v]+') AS ws FROM l)
SELECT lang, source, n, CASE WHEN len(ws) > 150 THEN array_to_string(ws[1:150], ' ') || '...' ELSE array_to_string(ws, ' ') END AS summary FROM w""")
def rolled_up_summaries(spark, sf_dir):
    """SUM-01, SUM-03, SUM-04: one level of a roll-up, over summaries of 100 words each."""
    heads = _docs(spark, sf_dir).filter(F.trim("text") != "").select("lang", "source", "doc_id", T.first_words(F.col("text"), 100).alias("head"))
    return summarise.roll_up(heads, ["lang", "source"], ["doc_id"], "head", 150)


@query("""
WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents), tf AS (SELECT source, term, count(*) AS tf FROM t WHERE length(term) > 3 GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), g AS (SELECT count(DISTINCT source)::DOUBLE AS g FROM documents)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY tf * ln((1 + g) / (1 + df)) DESC, term) AS INTEGER) AS place, term, tf, df FROM tf JOIN df USING (term), g QUALIFY place <= 5""")
def keywords(spark, sf_dir):
    """SUM-05."""
    return summarise.keywords(_docs(spark, sf_dir), ["source"], "text")


@query("SELECT source, sum(CASE lang WHEN 'en' THEN 1 ELSE 0 END)::BIGINT AS en, sum(CASE lang WHEN 'fr' THEN 1 ELSE 0 END)::BIGINT AS fr FROM documents GROUP BY source")
def by_agent(spark, sf_dir):
    """SUM-09, AGG-09."""
    return A.pivot_years(A.count_by(_docs(spark, sf_dir), "source", "lang"), ["en", "fr"], year="source", cluster="lang")


@query("""
SELECT doc_id, array_to_string(['<p>' || regexp_replace(replace(replace(replace(replace(trim(x, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\\*([^*]+)\\*', '<em>\\1</em>', 'g') || '</p>' for x in string_split_regex(text, '\\n[\\s\\v]*\\n') if trim(x, ' ') <> ''], chr(10)) AS html FROM documents""")
def html_paragraphs(spark, sf_dir):
    """FN-16, SNK-10."""
    return _docs(spark, sf_dir).select("doc_id", T.html_paragraphs(F.col("text")).alias("html"))


@query()
def fuzzy_pairs(spark, sf_dir):
    """JN-13, FN-18: titles and headings of each page, one to one."""
    parsed = readers.parse_pages(texts(spark, sf_dir, "pages"))
    titles = parsed.select(F.col("page_id").alias("block"), F.col("title").alias("a"))
    headings = parsed.select(F.col("page_id").alias("block"), F.explode("headings").alias("b"))
    return joins.greedy_pairs(titles, headings, "block", "a", "b")


@query()
def sentence_counts(spark, sf_dir):
    """FN-22: by boundaries learned from all documents."""
    docs = _docs(spark, sf_dir)
    count = boundaries.counter(boundaries.learn(docs))
    return docs.select("doc_id", count(F.col("text")).alias("n"))


@query("SELECT CAST(json_object('type', 'entity', 'name', source, 'entityType', 'book', 'observations', [CAST(count(*) AS VARCHAR)]) AS VARCHAR) AS value FROM documents GROUP BY source UNION ALL SELECT CAST(json_object('type', 'relation', 'from', source, 'to', lang, 'relationType', 'has') AS VARCHAR) FROM (SELECT DISTINCT source, lang FROM documents)")
def graph_lines(spark, sf_dir):
    """SNK-13."""
    docs = _docs(spark, sf_dir)
    entities = docs.groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.col("source").alias("name"), F.lit("book").alias("entityType"), F.array("n").alias("observations"))
    relations = docs.select(F.col("source").alias("from"), F.col("lang").alias("to"), F.lit("has").alias("relationType")).distinct()
    return reports.graph_lines(entities, relations)


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE lang END), ''), source) AS filled FROM documents")
def filled_slots(spark, sf_dir):
    """PRJ-03."""
    return _docs(spark, sf_dir).select("doc_id", T.fill_if_empty(F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.col("lang")), F.col("source")).alias("filled"))
