"""Files written and read back, reports, and parts of the search that stand on their own, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import analytics as A
from corpuslab.operators import clean, clustering, reports, retrieval, summarise
from corpuslab.plans.registry import Registry, table, texts
from corpuslab.plans.retrieval_queries import query_terms
from corpuslab.session import work_dir
from corpuslab.sources import readers, sinks

registry = Registry()
query = registry.query

_SPLIT = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')"


@query("SELECT source AS id, count(*) AS n, min(lang) AS first_lang FROM documents WHERE source IS NOT NULL GROUP BY source")
def keyed_records(spark, sf_dir):
    """SRC-11: one JSON object with a record for each source, written and read as a table."""
    path = work_dir(spark, "keyed")
    counts = table(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("lang").alias("first_lang"))
    entry = F.struct(F.col("source").alias("key"), F.struct("n", "first_lang").alias("value"))
    sinks.text_lines(counts.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")), path)
    return readers.keyed_json(spark, path, "id", "struct<n:bigint,first_lang:string>")


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels")
def csv_rows(spark, sf_dir):
    """SRC-12, SNK-05: rows of a CSV file by its header, numbers where they are."""
    path = work_dir(spark, "labels")
    sinks.csv(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), path)
    return readers.csv_records(spark, path, ("doc_id", "quality", "toxic"))


@query("SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents")
def stored_bytes(spark, sf_dir):
    """SRC-17: sizes of written files, without reading them: each text and a line's end."""
    path = work_dir(spark, "texts")
    table(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.text(path)
    return readers.file_facts(spark, path).agg(F.sum("length").alias("bytes"))


@query("SELECT CAST(vec_id AS BIGINT) AS citation_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings")
def record_pairs(spark, sf_dir):
    """SNK-06: records as JSON lines beside their vectors, joined again."""
    path = work_dir(spark, "pairs")
    sinks.pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("citation_id"), "label", "embedding"), path, ("embedding",))
    records = spark.read.schema("citation_id bigint, label bigint").json(f"{path}/records")
    stored = spark.read.parquet(f"{path}/vectors").select("citation_id", F.size("embedding").alias("dimension"))
    return records.join(stored, "citation_id")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, CASE WHEN i <= 5 THEN 1 ELSE 2 END AS num, CASE WHEN i <= 5 THEN 'head' ELSE 'rest' END AS title, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL""")
def ranges_of_pages(spark, sf_dir):
    """SRC-06: each document's lines as its pages, in two ranges."""
    pages = reports.lines_of(texts(spark, sf_dir), "doc_id", "text").select("doc_id", (F.col("line_no") + 1).alias("page_number"), F.col("line").alias("text"))
    return readers.page_ranges(spark, pages, [(1, "head", 1, 5), (2, "rest", 6, 2**31 - 1)], keys=("doc_id",))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '^([ \\t]*[═=━—‒-]{5,}[ \\t]*\\n|[ \\t]*\\n)+', ''), '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS overview FROM documents")
def overviews(spark, sf_dir):
    """TXT-23: each text as the overview behind a heading and a rule."""
    docs = texts(spark, sf_dir).select("doc_id", F.concat(F.lit("A report\n=====\nIntroduction\n\nBook Overview\n-----\n\n"), "text").alias("report"))
    return docs.select("doc_id", reports.overview(F.col("report")).alias("overview"))


@query(f"""
WITH p AS (SELECT doc_id, lang, source, list_filter([array_to_string(regexp_extract_all(x, '[^ \\t\\n\\r\\f\\v]+'), ' ') for x in string_split_regex(text, '\\n[\\s\\v]*\\n')], lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN 'On ' || source || ' at work' ELSE lang END AS title, CASE i WHEN 0 THEN array_to_string(ps, '|') ELSE 'one|two' END AS paragraphs FROM p, (SELECT unnest([0, 1]) AS i)""")
def numbered_reports(spark, sf_dir):
    """TXT-25: a report with each text as its first chapter, whose title goes over two lines."""
    report = F.concat(F.lit("Head\n=====\n1. On "), "source", F.lit("\n  at work\n-----\n"), "text", F.lit("\n\n2. "), "lang", F.lit("\n-----\none\n\ntwo\n=====\nNot read"))
    found = reports.parse_numbered(texts(spark, sf_dir).select("doc_id", report.alias("report")), "doc_id", "report")
    return found.withColumn("paragraphs", F.array_join("paragraphs", "|"))


@query(f"""
WITH w AS (SELECT doc_id, text, {_SPLIT} AS w FROM documents), c AS (SELECT *, array_to_string(w[1:60], ' ') AS cut FROM w), e AS (SELECT *, length(cut) - length(regexp_extract(cut, '([^.!?]*)$', 1)) AS stop FROM c)
SELECT doc_id, CASE WHEN len(w) <= 65 THEN text WHEN stop - 1 > length(cut) * 0.7 THEN substr(cut, 1, stop) ELSE array_to_string(w[1:50], ' ') || '...' END AS text FROM e""")
def guarded_lengths(spark, sf_dir):
    """SUM-07: texts as summaries that should have 50 words."""
    return texts(spark, sf_dir).select("doc_id", summarise.guard_length(F.col("text"), 50).alias("text"))


@query("""
SELECT conv_id, turn, text || coalesce(' ' || substr(before, 1, 300), '') AS question
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) WHERE role = 'user'""")
def rewritten_questions(spark, sf_dir):
    """RET-14: every question with the message before it."""
    return retrieval.rewritten(table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, regexp_replace(text || chr(10) || '  ' || n_chars || chr(10) || lang, '(?m)^\\s*\\d{1,4}\\s*$', '', 'g') AS text FROM documents")
def without_page_numbers(spark, sf_dir):
    """TXT-07: texts with their length as a page number, which goes if it has four digits or fewer."""
    marked = F.concat("text", F.lit("\n  "), F.col("n_chars").cast("string"), F.lit("\n"), "lang")
    return texts(spark, sf_dir).select("doc_id", clean.strip_page_numbers(marked).alias("text"))


@query()
def agglomerated(spark, sf_dir):
    """CLU-06: the labels' mean vectors, merged by Ward's rule until three clusters are left."""
    means = clustering.chapter_vectors(table(spark, sf_dir, "embeddings"), "label").withColumn("vec_id", F.col("label").cast("long"))
    return clustering.agglomerative(means, 3).select("vec_id", "cluster_id")


@query()
def agglomerated_vectors(spark, sf_dir):
    """CLU-06: all vectors, whatever their number, merged by Ward's rule until ten clusters are left."""
    return clustering.agglomerative(table(spark, sf_dir, "embeddings"), 10, most=None).select("vec_id", "cluster_id")


@query("""
SELECT label, CASE WHEN n_sources > 0 THEN first_source ELSE 'Cluster ' || label END AS title, n_docs || ' documents' AS explanation
FROM (SELECT label, min(source) AS first_source, count(source) AS n_sources, count(*) AS n_docs FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label)""")
def labelled_clusters(spark, sf_dir):
    """CLU-04: answers of a labeller, parsed; here each names a source of the cluster's documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    told = table(spark, sf_dir, "embeddings").join(docs, "vec_id").groupBy("label").agg(F.min("source").alias("first"), F.count(F.lit(1)).cast("string").alias("n"))
    answers = told.select("label", F.concat(F.coalesce(F.concat(F.lit("Label: "), "first", F.lit("\n")), F.lit("")), F.lit("EXPLANATION: "), "n", F.lit(" documents")).alias("answer"))
    title, why = clustering.parsed_label(F.col("answer"), F.col("label"))
    return answers.select("label", title.alias("title"), why.alias("explanation"))


@query("""
WITH q AS (SELECT list(DISTINCT term) AS terms FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)))
SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}')), terms)) AS INTEGER) AS n FROM documents, q""")
def shared_words(spark, sf_dir):
    """SET-03: how many distinct words each text shares with the first benchmark item."""
    wanted = F.array(*map(F.lit, query_terms(spark, sf_dir)))
    return texts(spark, sf_dir).select("doc_id", A.common_words(retrieval.default_terms(F.col("text")), wanted).alias("n"))
