"""Counts, shares, windows, joins and audits over the relational and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import analytics as A
from corpuslab.operators import filters as FL
from corpuslab.operators import joins as J
from corpuslab.plans.registry import Registry, table, texts
from corpuslab.streaming import streams

registry = Registry()
query = registry.query

_YEAR = "CAST(year(o_orderdate) AS INTEGER)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


@query("SELECT chunk_level AS level, count(*) AS n FROM (SELECT l_linenumber AS chunk_level FROM lineitem) GROUP BY 1")
def level_counts(spark, sf_dir):
    """AGG-01, PRJ-01."""
    return A.count_by(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("level")), "level")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 2)")
def level_filter(spark, sf_dir):
    """FLT-01, FLT-02."""
    return FL.levels(table(spark, sf_dir, "lineitem").withColumn("level", F.col("l_linenumber")), [1, 2]).select("l_orderkey", "l_linenumber")


@query("SELECT source, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))) AS BIGINT) AS words, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def library_totals(spark, sf_dir):
    """AGG-02, AGG-33, FN-01: sums a book, and of the library."""
    from corpuslab.functions import text as T

    docs = table(spark, sf_dir, "documents").select("source", T.word_count(F.col("text")).alias("words"), F.col("n_chars").alias("chars"))
    return A.totals(docs, "source", "words", "chars")


@query("SELECT lang, count(*) AS n, CAST(floor(avg(length(text))) AS BIGINT) AS mean_chars, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, CAST(floor(avg(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))) AS BIGINT) AS mean_words FROM documents GROUP BY lang")
def level_stats(spark, sf_dir):
    """AGG-03."""
    return A.level_stats(table(spark, sf_dir, "documents"), "lang", "text")


@query("""
SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first, o_orderpriority) = 1""")
def plurality_cluster(spark, sf_dir):
    """AGG-04: chapter to primary cluster, as customer to most frequent priority; of equals, the first seen."""
    return A.plurality(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query(f"SELECT o_custkey, year, n FROM (SELECT o_custkey, {_YEAR} AS year, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first, year) = 1")
def modal_year(spark, sf_dir):
    """AGG-05."""
    return A.plurality(_orders(spark, sf_dir), ["o_custkey"], "year", "o_orderkey")


@query(f"""
WITH p AS (SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first, o_orderpriority) = 1),
y AS (SELECT o_custkey, year FROM (SELECT o_custkey, {_YEAR} AS year, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first, year) = 1)
SELECT o_orderpriority, year, count(*) AS n FROM p JOIN y USING (o_custkey) WHERE year BETWEEN 1970 AND 2030 GROUP BY 1, 2""")
def timeline_chapters(spark, sf_dir):
    """AGG-06, FLT-05: cluster and year of each chapter's most frequent ones."""
    orders = _orders(spark, sf_dir)
    cluster = A.plurality(orders, ["o_custkey"], "o_orderpriority", "o_orderkey").drop("n")
    year = A.plurality(orders, ["o_custkey"], "year", "o_orderkey").drop("n")
    return A.count_by(cluster.join(year, "o_custkey").filter(FL.plausible_year(F.col("year"))), "o_orderpriority", "year")


@query(f"SELECT o_orderpriority, {_YEAR} AS year, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY {_YEAR}), 1) AS pct FROM orders GROUP BY 1, 2")
def timeline_share(spark, sf_dir):
    """AGG-07, AGG-08, WIN-12."""
    return A.share_of_year(A.count_by(_orders(spark, sf_dir), "o_orderpriority", "year"))


@query(f"""
SELECT {_YEAR} AS year, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS urgent, CAST(count(*) FILTER (o_orderpriority = '2-HIGH') AS BIGINT) AS high, CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS BIGINT) AS low FROM orders GROUP BY 1""")
def timeline_pivot(spark, sf_dir):
    """AGG-09, SNK-07, FLT-06."""
    counts = A.count_by(_orders(spark, sf_dir), "year", "o_orderpriority")
    wide = A.pivot_years(counts, ["1-URGENT", "2-HIGH", "5-LOW"], cluster="o_orderpriority")
    return wide.select("year", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


@query("""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, n, round(CASE WHEN count(n) OVER w >= 2 THEN avg(n) OVER w END, 6) AS rolling FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_mean_5(spark, sf_dir):
    """WIN-04: five rows around, over present days."""
    days = A.count_by(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "event_type", "day")
    return A.rolling_mean(days, ["event_type"], "day", "n").withColumn("rolling", F.round("rolling", 6))


@query(f"SELECT o_orderstatus, {_YEAR} AS year, count(*) AS n, CAST(grouping_id(o_orderstatus, {_YEAR}) AS BIGINT) AS level, round(ln(1 + count(*)), 6) AS log_n FROM orders GROUP BY CUBE (o_orderstatus, {_YEAR})")
def crosstab_cube(spark, sf_dir):
    """AGG-10, FN-25."""
    return A.crosstab(_orders(spark, sf_dir), "o_orderstatus", "year")


@query(f"WITH c AS (SELECT o_orderpriority, {_YEAR} AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2, 3) SELECT *, round(greatest(14.0::DOUBLE, n / max(n) OVER (PARTITION BY o_orderpriority)::DOUBLE * 320), 6) AS size FROM c")
def bubble_sizes(spark, sf_dir):
    """AGG-11."""
    return A.bubble_sizes(_orders(spark, sf_dir), "o_orderpriority", "year", "o_orderstatus").withColumn("size", F.round("size", 6))


@query("SELECT l_returnflag, count(*) AS n, min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1")
def span_summary(spark, sf_dir):
    """AGG-12."""
    return A.span_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity")


@query(f"""
WITH c AS (SELECT o_orderpriority, {_YEAR} AS year, CAST(o_custkey % 40 AS INTEGER) AS cited, count(*) AS n FROM orders GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, year ORDER BY n DESC, cited) AS place FROM c QUALIFY place <= 10)
SELECT o_orderpriority, year, string_agg(cited || '(' || n || ')', ', ' ORDER BY place) AS cited FROM t GROUP BY 1, 2""")
def nested_timeline(spark, sf_dir):
    """AGG-13."""
    rows = _orders(spark, sf_dir).withColumn("cited", (F.col("o_custkey") % 40).cast("int"))
    return A.nested_timeline(rows, "o_orderpriority", "year", "cited")


@query("WITH c AS (SELECT CAST(o_custkey % 60 AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, year LIMIT 25) SELECT year, n, repeat('█', greatest(1, round(n / max(n) OVER ()::DOUBLE * 35)::INT)) AS bar FROM c")
def top_bars(spark, sf_dir):
    """AGG-14, SNK-09."""
    return A.top_bars(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("year")), "year")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) <= 5")
def top_books(spark, sf_dir):
    """AGG-17, AGG-23."""
    return A.ranked_within(A.count_by(table(spark, sf_dir, "documents"), "source", "lang"), ["lang"], [F.desc("n"), F.col("source")], 5).drop("place")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))) AS BIGINT) AS words, count(*) AS n_chunks, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def joined_texts(spark, sf_dir):
    """AGG-18."""
    return A.joined_texts(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", ["role"])


@query("SELECT count(DISTINCT source) AS books, count(DISTINCT lang) AS langs, count(*) AS n FROM documents")
def distinct_counts(spark, sf_dir):
    """AGG-19."""
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("books"), F.count_distinct("lang").alias("langs"), F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (contains(text, 'icens')) AS n_licence, coalesce(bool_or(contains(text, 'icens')), false) AS any_licence, count(*) FILTER (n_chars > 5000) AS n_long, coalesce(bool_or(n_chars > 5000), false) AS any_long FROM documents GROUP BY lang")
def conditional_counts(spark, sf_dir):
    """AGG-20."""
    return A.conditional_counts(table(spark, sf_dir, "documents"), ["lang"], licence=F.contains("text", F.lit("icens")), long=F.col("n_chars") > 5000)


@query("SELECT round(100 * avg(CAST(regexp_matches(text, '[0-9]{3}') AS INTEGER)), 2) AS pct FROM documents")
def share_with_numbers(spark, sf_dir):
    """AGG-21."""
    return A.share_like(table(spark, sf_dir, "documents"), "text", "[0-9]{3}")


@query("SELECT o_orderstatus AS outcome, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY 1")
def outcome_histogram(spark, sf_dir):
    """AGG-22, CIT-06."""
    return A.outcome_histogram(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "outcome"), "outcome")


@query("""
WITH m AS (SELECT avg(o_totalprice) FILTER (y BETWEEN 1992 AND 1994) AS pe, avg(o_totalprice) FILTER (y BETWEEN 1996 AND 1998) AS pl, avg(o_custkey) FILTER (y BETWEEN 1992 AND 1994) AS ke, avg(o_custkey) FILTER (y BETWEEN 1996 AND 1998) AS kl FROM (SELECT *, year(o_orderdate) AS y FROM orders))
SELECT 'o_totalprice' AS metric, round(pe, 4) AS early, round(pl, 4) AS late, round(pl - pe, 4) AS delta FROM m UNION ALL SELECT 'o_custkey', round(ke, 4), round(kl, 4), round(kl - ke, 4) FROM m""")
def early_and_late(spark, sf_dir):
    """AGG-24."""
    out = A.early_and_late(_orders(spark, sf_dir), "year", ["o_totalprice", "o_custkey"], (1992, 1994), (1996, 1998))
    return out.select("metric", *(F.round(c, 4).alias(c) for c in ("early", "late", "delta")))


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def global_means(spark, sf_dir):
    """AGG-25."""
    means = A.global_means(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return means.select(*(F.round(c, 6).alias(c) for c in means.columns))


@query("""
SELECT source, field, count(*) AS n FROM (SELECT source, unnest(list_filter([CASE WHEN doc_id IS NULL OR doc_id = 0 THEN 'doc_id' END, CASE WHEN text IS NULL OR trim(text) = '' THEN 'text' END, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'lang' END, CASE WHEN n_chars IS NULL OR n_chars < 200 THEN 'n_chars' END], lambda x: x IS NOT NULL)) AS field FROM documents) GROUP BY GROUPING SETS ((source, field), (field))""")
def empty_slot_audit(spark, sf_dir):
    """FLT-14, AGG-26: empty fields a book and in all; texts under 200 characters count as without length here."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang", F.when(F.col("n_chars") >= 200, F.col("n_chars")).alias("n_chars"))
    found = FL.empty_slots(docs, ["source"])
    return found.groupingSets([("source", "field"), ("field",)], "source", "field").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w, len([x for x in string_split(text, chr(10)) if trim(x) <> '']) AS l,
  len([x for x in string_split(text, chr(10)) if trim(x) <> '' AND regexp_matches(x, '(?i)(?:\\([12]\\d{3}[/,\\-a-z\\d]*\\)|pp\\.\\s*\\d+|Vol\\.\\s*\\d+|\\bdoi:|\\bPress\\b)')]) AS h FROM documents),
f AS (SELECT w, l >= 4 AND h::DOUBLE / l > 0.5 AS b FROM d)
SELECT count(*) AS total, count(*) FILTER (b) AS excluded_biblio, count(*) FILTER (NOT b AND w < 50) AS excluded_short, count(*) FILTER (NOT b AND w >= 50) AS kept,
  CAST(sum(w) AS BIGINT) AS words_original, CAST(sum(w) FILTER (NOT b) AS BIGINT) AS words_narrative, CAST(sum(w) FILTER (NOT b AND w >= 50) AS BIGINT) AS words_kept FROM f""")
def funnel_counts(spark, sf_dir):
    """FLT-09, FLT-11, FLT-12, AGG-27."""
    return FL.funnel(texts(spark, sf_dir), "text", "text")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS chapter_words FROM lineitem) WHERE chapter_words < 100")
def small_chapters(spark, sf_dir):
    """AGG-28."""
    return A.small_chapters(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "chapter_words")


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS chapters, min(o_orderkey) AS first_page, max(o_orderkey) AS last_page, round(sum(o_totalprice), 2) AS words FROM orders GROUP BY 1")
def book_overview(spark, sf_dir):
    """AGG-29."""
    return A.book_overview(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey", "o_totalprice").withColumn("words", F.round("words", 2))


@query("SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def median_by(spark, sf_dir):
    """AGG-30."""
    return A.median_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY event_type""")
def box_numbers(spark, sf_dir):
    """AGG-31."""
    out = A.box_numbers(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "low", "high")))


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)")
def runs(spark, sf_dir):
    """WIN-03 without a cap: runs of one kind of event."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    return A.runs(events, "user_id", "event_id", F.col("event_type") == F.col("before")).select("user_id", "event_id", "run")


@query("SELECT o_custkey, o_orderkey, year, before IS DISTINCT FROM year AS new_year FROM (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, lag(CAST(year(o_orderdate) AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)")
def year_marks(spark, sf_dir):
    """WIN-15, TOP-09."""
    return A.year_marks(_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], "year").select("o_custkey", "o_orderkey", "year", "new_year")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders UNION SELECT CAST(year(l_shipdate) AS INTEGER) FROM lineitem")
def all_years(spark, sf_dir):
    """SET-01."""
    return A.all_years(_orders(spark, sf_dir), table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate")))


@query("SELECT p_brand, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def dedupe_first(spark, sf_dir):
    """SET-04, SET-05, SRC-08."""
    from corpuslab.sources.readers import first_of

    return first_of(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_brand", "p_name", "p_retailprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_unordered(spark, sf_dir):
    """JN-05, SET-06."""
    return J.anti(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_join_labelled(spark, sf_dir):
    """JN-04."""
    return J.semi(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").filter("quality = 1"), ["doc_id"])


@query("SELECT d.doc_id, d.lang, coalesce(CAST(l.quality AS INTEGER), -1) AS quality, coalesce(CAST(l.toxic AS INTEGER), -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_with_default(spark, sf_dir):
    """JN-02, JN-03."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return J.equi_or_default(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, ["doc_id"], {"quality": F.lit(-1), "toxic": F.lit(-1)})


@query("SELECT coalesce(d.id, e.id) AS id, CASE WHEN d.id IS NULL THEN 'right_only' WHEN e.id IS NULL THEN 'left_only' ELSE 'matched' END AS outcome FROM (SELECT DISTINCT doc_id AS id FROM documents) d FULL JOIN (SELECT DISTINCT vec_id AS id FROM embeddings) e ON d.id = e.id")
def reconciliation(spark, sf_dir):
    """JN-06, FLT-04."""
    return J.reconcile(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id")


@query("""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]+'), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(line) AS n, name FROM a JOIN b USING (doc_id, pos)""")
def zipped_lines(spark, sf_dir):
    """JN-17."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.split("text", "\n").alias("line"))
    names = docs.select("doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("name"))
    return J.zipped(lines, names, "doc_id", "line", "name").select("doc_id", "pos", F.length("line").cast("long").alias("n"), "name")


@query("""
WITH m AS (SELECT o_orderpriority AS from_cluster, CAST(year(o_orderdate) AS INTEGER) AS cited_year, count(*) AS c FROM orders GROUP BY 1, 2), y AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS cited_year, l_returnflag AS to_cluster, count(*) AS m FROM lineitem GROUP BY 1, 2)
SELECT from_cluster, to_cluster, CAST(sum(c * m) AS BIGINT) AS n FROM m JOIN y USING (cited_year) GROUP BY 1, 2""")
def citation_matrix(spark, sf_dir):
    """JN-18."""
    cites = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("cluster"), F.col("year").alias("cited_year"))
    chapters = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.year("l_shipdate").alias("pub_year"))
    return J.citation_matrix(cites, chapters)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    """Extension: fixed windows; the function serves streams alike."""
    return streams.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""
SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w0, ts FROM events) x, LATERAL (SELECT CASE WHEN true THEN w0 END AS w) GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    """Extension: two-day windows every day."""
    return streams.sliding(table(spark, sf_dir, "events"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    """Extension: sessions with gaps under half an hour."""
    return streams.sessions(table(spark, sf_dir, "events"))
