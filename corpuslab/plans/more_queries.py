"""Operators that the tables have no case for: each document gets a made-up one, by its id, in both engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpuslab.functions import fuzzy, stemming
from corpuslab.functions import text as T
from corpuslab.functions import vectors as V
from corpuslab.operators import analytics as A
from corpuslab.operators import chunking, clean, clustering, filters, joins, reports, retrieval, summarise
from corpuslab.plans.registry import Registry, table
from corpuslab.session import work_dir
from corpuslab.sources import model, readers, sinks
from corpuslab.streaming import streams

registry = Registry()
query = registry.query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _case(n: int, *texts):
    """One of the texts by doc_id."""
    return reduce(lambda c, x: c.when(F.col("doc_id") % n == x[0], x[1]), list(enumerate(texts))[1:], F.when(F.col("doc_id") % n == 0, texts[0]))


def _sql_case(*values) -> str:
    quoted = ["NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


def _expected(column: str, *values) -> str:
    return f"SELECT doc_id, {_sql_case(*values)} AS {column} FROM documents"


_TITLES = ("Chapter IV. Foo's Bar by Jane Doe", "12. Deep  Thought", "Introduction to Part I: Groups at Work", "Mix: of things")


@query(_expected("form", "foos bar", "deep thought", "groups at work", "of things"))
def normalised_titles(spark, sf_dir):
    """FN-06, TRAP-21."""
    return _docs(spark, sf_dir).select("doc_id", T.normalise_title(_case(4, *_TITLES)).alias("form"))


@query(f"SELECT doc_id, 'Ab_c_' || doc_id AS name, '10.1000/x' || doc_id AS doi, {_sql_case('Ann Lee, Bo Chen', 'A B, C')} AS authors FROM documents")
def identifiers(spark, sf_dir):
    """FN-10, FN-11, FN-12, FN-13."""
    n = F.col("doc_id").cast("string")
    authors = T.join_authors(T.strip_superscripts(_case(2, "Ann Lee1 · Bo Chen23", "A B & C4")))
    return _docs(spark, sf_dir).select("doc_id", T.safe_filename(F.concat(F.lit("A:b?  c "), n)).alias("name"), T.doi(F.concat(F.lit("see 10.1000/x"), n, F.lit(".,"))).alias("doi"), authors.alias("authors"))


@query("SELECT doc_id, CAST(doc_id % 30 + 1 AS INTEGER) AS value FROM documents")
def roman_numbers(spark, sf_dir):
    """FN-14."""
    signs = F.array(*(F.lit(T.roman(i)) for i in range(1, 31)))
    return _docs(spark, sf_dir).select("doc_id", T.roman_value(F.lower(F.element_at(signs, (F.col("doc_id") % 30 + 1).cast("int")))).alias("value"))


@query("SELECT doc_id, lang || '|' || source || '|end' AS keywords FROM documents")
def keyword_lists(spark, sf_dir):
    """FN-17."""
    line = F.concat(F.lit("Keywords: "), "lang", F.lit(", "), "source", F.lit("; end."))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.keyword_list(line), "|").alias("keywords"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(50 + 150 * (event_id % 4) // 3 AS INTEGER) AS words FROM events")
def days_and_lengths(spark, sf_dir):
    """FN-31, FN-33."""
    level = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", T.day_of(F.col("ts")).alias("day"), T.summary_words(level, F.lit(4)).alias("words"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, 1.0::DOUBLE AS self_cosine FROM embeddings")
def vector_norms(spark, sf_dir):
    """FN-23, CLU-02."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 5).alias("norm"), F.round(V.dot(V.unit(v), V.unit(v)), 6).alias("self_cosine"))


@query("SELECT doc_id, 'A study of ' || lang AS title, 'Ann Lee, Bo Chen' AS authors FROM documents")
def text_headers(spark, sf_dir):
    """FN-34."""
    head = F.concat(F.lit("Volume 3\nA study of\n"), "lang", F.lit("\nAnn Lee1 · Bo Chen2\nText follows"))
    return _docs(spark, sf_dir).select("doc_id", fuzzy.header(head).alias("h")).select("doc_id", "h.title", "h.authors")


@query("SELECT doc_id, lang || ' at work' AS title, source AS authors FROM documents")
def block_headers(spark, sf_dir):
    """FN-35."""
    blocks = F.array(F.concat("lang", F.lit("\nat  work")), F.col("source"), F.lit("rest"))
    return _docs(spark, sf_dir).select("doc_id", fuzzy.header_blocks(blocks).alias("h")).select("doc_id", "h.title", "h.authors")


@query(f"SELECT doc_id, {_sql_case('consist', 'run', 'communiti')} AS stem, CAST({_sql_case(0, 1, 0)} AS BOOLEAN) AS stop FROM documents")
def stems_and_stop_words(spark, sf_dir):
    """RET-04: Porter2 stems; the stop list."""
    words = F.array(_case(3, "consistency", "running", "communities"))
    return _docs(spark, sf_dir).select("doc_id", stemming.stems(words)[0].alias("stem"), _case(3, "house", "the", "book").isin(*stemming.STOP_WORDS).alias("stop"))


@query()
def bm25_stemmed(spark, sf_dir):
    """RET-05 with the library's own tokens: stop words out, stems in."""
    question = spark.createDataFrame([("the running of communities and their organisation",)], "t string")
    terms = question.select(retrieval.plain_terms(F.col("t")).alias("t")).first()["t"]
    scored = retrieval.bm25_scores(_docs(spark, sf_dir), [*terms, "the", "and"], terms=retrieval.plain_terms)
    return retrieval.top(scored.unionByName(_docs(spark, sf_dir).select("doc_id", F.lit(0.0).alias("score"))), 5, "doc_id")


@query(f"SELECT doc_id, {_sql_case(1, 3, None)} AS number, {_sql_case('exact', 'normalised', None)} AS tier FROM documents")
def two_tier_titles(spark, sf_dir):
    """JN-07."""
    parsed = _docs(spark, sf_dir).select("doc_id", _case(3, "Foo", "Chapter 2. Foo's Bar", "Nowhere").alias("title"))
    catalogue = spark.createDataFrame([("Foo", 1), ("Foos Bar", 2), ("Foo's bar", 3)], "title string, number int")
    return joins.two_tier(parsed, catalogue, "title", "number").select("doc_id", "number", "tier")


@query("SELECT CAST(doc_id AS INTEGER) AS volume, 2 AS issue, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE lang END AS text FROM documents")
def issues_matched(spark, sf_dir):
    """JN-16: a filled text is kept, an empty one taken from the chapter of the same issue."""
    volume = F.col("doc_id").cast("int")
    editorials = _docs(spark, sf_dir).select(volume.alias("volume"), F.lit(2).alias("issue"), F.when(F.col("doc_id") % 2 == 0, "own").alias("text"))
    chapters = _docs(spark, sf_dir).select(F.concat(volume.cast("string"), F.lit("(2): A title")).alias("title"), F.col("lang").alias("text"))
    return joins.by_issue(editorials, chapters, "title")


def _headings(docs, rows):
    items = F.explode(F.array(*(F.struct(F.lit(p).alias("position"), F.lit(t).alias("text"), F.lit(lv).alias("level"), F.lit(pg).alias("page"), F.lit(fs).alias("font_size")) for p, t, lv, pg, fs in rows))).alias("h")
    return docs.select("doc_id", items).select("doc_id", "h.*")


@query("SELECT doc_id, unnest([0, 20]) AS position, unnest(['A long heading', 'Next']) AS text FROM documents")
def split_headings(spark, sf_dir):
    """WIN-06."""
    rows = [(0, "A long head-", 1, 1, 20.0), (9, "ing", 1, 1, 20.2), (20, "Next", 1, 2, 20.0)]
    return A.merge_split_headings(_headings(_docs(spark, sf_dir), rows), "doc_id").select("doc_id", "position", "text")


@query("SELECT doc_id, unnest([0, 12, 20]) AS position, unnest(['Seeds and reseeding', 'and more', 'Next']) AS text FROM documents")
def continued_headings(spark, sf_dir):
    """WIN-07."""
    rows = [(0, "Seeds", 1, 1, 20.0), (9, "and reseeding", 1, 2, 20.0), (12, "and more", 1, 2, 20.0), (20, "Next", 1, 3, 20.0)]
    return A.merge_continuations(_headings(_docs(spark, sf_dir), rows), "doc_id").select("doc_id", "position", "text")


@query("SELECT doc_id, unnest([0, 20]) AS position, unnest(['Introduction to Part I: On Groups', 'Next']) AS text FROM documents")
def part_headings(spark, sf_dir):
    """WIN-08."""
    rows = [(0, "Part I", 1, 1, 36.0), (5, "On Groups", 1, 1, 36.0), (9, "Introduction to Part I", 1, 2, 22.0), (20, "Next", 1, 3, 22.0)]
    return A.collapse_parts(_headings(_docs(spark, sf_dir), rows), "doc_id").select("doc_id", "position", "text")


@query("SELECT doc_id, unnest([0, 40]) AS position FROM documents")
def chapter_headings(spark, sf_dir):
    """FLT-03, FLT-10, FLT-17: level, size, sentences, front matter and an allow-list."""
    rows = [(0, "Groups at work", 1, 1, 20.0), (10, "Small print", 1, 1, 12.0), (20, "A whole sentence that was set in a large size by some accident.", 1, 1, 20.0), (30, "References", 1, 1, 20.0), (40, "Introduction", 1, 1, 20.0), (50, "A section", 2, 1, 20.0), (60, "ab", 1, 1, 20.0)]
    heads = _headings(_docs(spark, sf_dir), rows).withColumn("doc", F.lit("2.book")).filter(filters.heading_like(F.col("text"), F.col("font_size") + 1))
    allowed = spark.createDataFrame([("2.book", "introduction")], "doc string, allowed_title string")
    return filters.chapter_heading(1, 13.0, allowed)(heads).select("doc_id", "position")


@query(f"SELECT doc_id, CAST({_sql_case(1, 1, 0)} AS BOOLEAN) AS legacy, CAST({_sql_case(0, 1, 0)} AS BOOLEAN) AS structural, CAST({_sql_case(1, 0, 1)} AS BOOLEAN) AS question FROM documents")
def title_rules(spark, sf_dir):
    """FLT-08, FLT-15, FLT-16."""
    title = _case(3, "Introduction to X", "Notes on Y", "A chapter")
    asked = _case(3, "why?", " quit ", "and then")
    return _docs(spark, sf_dir).select("doc_id", T.is_legacy_excluded_title(title).alias("legacy"), filters.structural_title(title).alias("structural"), filters.is_question(asked).alias("question"))


@query("SELECT doc_id + 1 + (SELECT count(*) FROM labels) AS id, lang FROM documents")
def next_ids(spark, sf_dir):
    """WIN-14."""
    old = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("id"))
    return A.next_ids(_docs(spark, sf_dir).select("doc_id", "lang"), old, "id", "doc_id").select(F.col("id").cast("long").alias("id"), "lang")


_PROSE = "Then, narrative resumes here with a long enough line of text."
_CLEANING = {
    "header": ("a\nBook Title\n  \n 12 \nb", "a\nb", clean.strip_running_headers),
    "refs": ("text\n References \nA (2001)", "text", clean.strip_references),
    "turns": ("x\n10 \nAnnB: \nhello\ny", "x\n10 AnnB: hello\ny", clean.join_turns),
    "logs": (f"before\nLog 3-1.\nhm hi\n{_PROSE}", f"before\n{_PROSE}", clean.strip_logs),
    "run_of_three": ("1 a: x\n2 b: y\n3 c: z\nprose", "prose", clean.strip_turn_runs),
    "run_of_two": ("1 a: x\n2 b: y\nprose", "1 a: x\n2 b: y\nprose", clean.strip_turn_runs),
    "caption": ("a\nFigure 3. Caption\nb", "a\n\nb", clean.strip_captions),
    "footnote": ("t\n\n1 Miller, J. (1999), p. 3\n\nm", "t\n\n\n\nm", clean.strip_footnotes),
}


def _lines_sql(text: str) -> str:
    return "source || ' ' || '" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("SELECT doc_id, " + ", ".join(f"{_lines_sql(after)} AS {name}" if name not in ("run_of_three", "run_of_two") else "'" + after.replace("\n", "' || chr(10) || '") + f"' || source AS {name}" for name, (_, after, _f) in _CLEANING.items()) + " FROM documents")
def cleaning_steps(spark, sf_dir):
    """TXT-01..06, TXT-08, WIN-09, WIN-10, one by one."""

    def column(name, before, step):
        text = F.concat(F.lit(before), "source") if name.startswith("run") else F.concat("source", F.lit(" "), F.lit(before))
        return step(text).alias(name)

    return _docs(spark, sf_dir).select("doc_id", *(column(name, before, step) for name, (before, _, step) in _CLEANING.items()))


_REPORT = "Chapter 1: A\n-----\nbody {}\nKeywords: k\nCHAPTER II: B\nbody b\nChapter 1. again\nmore a\n\nOVERVIEW\nall in all"


def _reports(spark, sf_dir, template):
    return _docs(spark, sf_dir).select("doc_id", F.replace(F.lit(template), F.lit("{}"), F.col("lang")).alias("report"))


@query("SELECT doc_id, unnest([0, 1, 2]) AS chapter, unnest(['all in all', 'body ' || lang || chr(10) || chr(10) || 'more a', 'body b']) AS text FROM documents")
def report_chapters(spark, sf_dir):
    """TXT-20, TXT-22, SRC-15."""
    return reports.chapter_texts(_reports(spark, sf_dir, _REPORT), "doc_id", "report")


_SECTIONS = "Title\n=====\nPART ONE\n=====\nChapter 1: Alpha\n=====\nBody of {}.\nAnd a second line that is long enough.\nKeywords: x, y\n=====\nOther\nBody of other, long enough to count as one.\n"


@query("SELECT doc_id, unnest([0, 1]) AS pos, unnest(['Chapter 1: Alpha', 'Other']) AS title, unnest(['Body of ' || lang || '.' || chr(10) || 'And a second line that is long enough.', 'Body of other, long enough to count as one.']) AS body, unnest(['x|y', '']) AS keywords FROM documents")
def report_sections(spark, sf_dir):
    """TXT-21."""
    return reports.parse_sections(_reports(spark, sf_dir, _SECTIONS), "doc_id", "report").withColumn("keywords", F.array_join("keywords", "|"))


@query("SELECT doc_id, CAST(1000 + doc_id AS BIGINT) AS n FROM documents")
def scraped_numbers(spark, sf_dir):
    """SRC-16."""
    text = F.concat(F.lit("Citations found: 1,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(" in all"))
    base = (F.col("doc_id") - F.col("doc_id") % 1000).cast("long")
    return _docs(spark, sf_dir).select("doc_id", (reports.scraped_numbers(text, "Citations found") + base).alias("n"))


@query("SELECT doc_id, 'a<h1>' || lang || '</h1>b<hr>c!<h1>Y</h1>d' AS inserted, 'a<h1>' || lang || '</h1>Z<hr>c<h1>Y</h1>d' AS replaced, 'a<hr>c<h1>' || lang || '</h1>b<h1>Y</h1>d' AS moved FROM documents")
def html_edits(spark, sf_dir):
    """TXT-24."""
    html = F.concat(F.lit("a<h1>"), "lang", F.lit("</h1>b<hr>c<h1>Y</h1>d"))
    docs = _docs(spark, sf_dir).select("doc_id", html.alias("h"))
    h = F.col("h")
    return docs.select("doc_id", reports.insert_before(h, "<h1>Y", F.lit("!")).alias("inserted"), reports.replace_between(h, "</h1>", "<hr>", F.lit("Z")).alias("replaced"), reports.move_section(h, "<h1>", "<hr>", "<h1>Y").alias("moved"))


@query("SELECT '1.' || lang || doc_id AS stem, '1.' || lang || doc_id || ', tell it' AS prompt FROM documents UNION ALL SELECT '2.' || source || doc_id, '2.' || source || doc_id || ' say it' FROM documents")
def prompt_files(spark, sf_dir):
    """TXT-26."""
    n = F.col("doc_id").cast("string")
    files = _docs(spark, sf_dir).select(F.concat(F.lit("1."), "lang", n, F.lit(", tell it\n\n2."), "source", n, F.lit(" say it")).alias("t"))
    return reports.prompts(files, "t")


@query("SELECT CAST(2 + doc_id % 20 AS INTEGER) AS book_number, count(*) AS chapters, max(CASE WHEN 2 + doc_id % 20 = 5 THEN '' ELSE 'book ' || (2 + doc_id % 20) END) AS title FROM documents GROUP BY 1")
def catalogue_ingest(spark, sf_dir):
    """SRC-03, SNK-05: written as a positional CSV file, read as books and chapters; book 5 has no row of its own."""
    book = 2 + F.col("doc_id") % 20
    chapter = _docs(spark, sf_dir).select(book.alias("n"), F.lit("").alias("name"), F.lit("").alias("title"), F.lit("").alias("kind"), (1 + F.col("doc_id")).alias("ch"), F.col("lang").alias("author"), F.col("source").alias("chapter"), F.lit("r").alias("ref"))
    books = chapter.select("n").distinct().filter("n <> 5").select("n", F.lit("x").alias("name"), F.concat(F.lit("book "), F.col("n").cast("string")).alias("title"), F.lit("k").alias("kind"), F.lit(0).cast("long").alias("ch"), F.lit("a").alias("author"), F.lit("").alias("chapter"), F.lit("r").alias("ref"))
    path = work_dir(spark, "catalogue")
    sinks.csv(books.unionByName(chapter), path)
    read_books, read_chapters = readers.catalogue(spark, path)
    counts = read_chapters.groupBy("book_number").agg(F.count(F.lit(1)).alias("chapters"))
    return counts.join(read_books, "book_number").select("book_number", "chapters", F.col("book_title").alias("title"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')[1:10], ' ') AS text, lang FROM documents")
def json_mirror(spark, sf_dir):
    """SNK-02, SRC-13, FN-28: written with texts cut, read back line by line."""
    path = work_dir(spark, "mirror")
    sinks.json_mirror(_docs(spark, sf_dir).select("doc_id", "text", "lang"), path)
    return readers.json_lines(spark, path, "doc_id bigint, text string, lang string")


@query("SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, role FROM conversations WHERE turn = 0")
def appended_log(spark, sf_dir):
    """SNK-01, SNK-08, RET-12: an append adds rows and rewrites none."""
    path, rows = work_dir(spark, "log"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    sinks.append(rows, path)
    sinks.append(rows.filter("turn = 0"), path)
    return spark.read.parquet(path)


@query("SELECT CAST(label AS INTEGER) AS book_number, count(*) AS n, CAST(sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END) AS BIGINT) AS with_vector, 0::BIGINT AS titled FROM embeddings GROUP BY 1")
def evolved_schema(spark, sf_dir):
    """SRC-01, SRC-02, SRC-09, SRC-14, SNK-03: an older vector table read by the present schema."""
    path = work_dir(spark, "vectors")
    sinks.vectors(table(spark, sf_dir, "embeddings"), path, "offline")
    rows = model.load(spark, f"{path}/vectors", "vectors", {"vec_id": "vector_id", "label": "book_number"})
    return rows.groupBy("book_number").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") == 64).alias("with_vector"), F.count("book_title").alias("titled"))


@query("SELECT conv_id, turn, role FROM conversations")
def streamed_log(spark, sf_dir):
    """STR-01: the log as a stream of files, appended once each."""
    path = work_dir(spark, "stream")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lit("2024-01-01T00:00:00").alias("timestamp")).write.json(f"{path}/in")
    log = streams.query_log(spark, f"{path}/in", "conv_id bigint, turn bigint, role string, timestamp string")
    streams.append_log(log, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, CAST(least(8, row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS BIGINT) AS kept FROM conversations")
def conversation_memory(spark, sf_dir):
    """STR-02: messages that a session remembers after each turn."""
    path = work_dir(spark, "memory")
    table(spark, sf_dir, "conversations").write.json(f"{path}/in")
    rows = spark.readStream.schema("conv_id long, turn long, role string, text string").json(f"{path}/in")
    streams.conversation_state(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')[1:5], ' ') || CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) > 5 THEN '...' ELSE '' END AS summary FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_summaries(spark, sf_dir):
    """SUM-02, STR-03: only units without a summary are worked on."""
    return summarise.fill_missing(_docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"], "text", 5)


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 12")
def first_samples(spark, sf_dir):
    """TOP-10."""
    return retrieval.samples(_docs(spark, sf_dir).select("doc_id", "source"), 12, "source", "doc_id")


@query("""
WITH u AS (SELECT vec_id, label, [x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v)) AS far, count(*) AS n FROM u a JOIN u b ON true GROUP BY ALL),
s AS (SELECT vec_id, max(n) FILTER (other = label) AS own_n, max(far / (n - 1)) FILTER (other = label AND n > 1) AS own, min(far / n) FILTER (other <> label) AS nearest FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN own_n = 1 THEN 0 ELSE (nearest - own) / greatest(own, nearest) END), 6) AS silhouette FROM s""")
def silhouette_of_labels(spark, sf_dir):
    """AGG-32."""
    rows = table(spark, sf_dir, "embeddings").withColumn("cluster_id", F.col("label").cast("int"))
    return spark.createDataFrame([(round(clustering.silhouette(rows), 6),)], "silhouette double")


@query("""
WITH u AS (SELECT vec_id, label, [x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE 1 - list_dot_product(a.v, b.v) END) AS far, count(*) AS n FROM u a JOIN u b ON true GROUP BY ALL),
s AS (SELECT vec_id, max(n) FILTER (other = label) AS own_n, max(far / (n - 1)) FILTER (other = label AND n > 1) AS own, min(far / n) FILTER (other <> label) AS nearest FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN own_n = 1 THEN 0 ELSE (nearest - own) / greatest(own, nearest) END), 6) AS silhouette FROM s""")
def cosine_silhouette_of_labels(spark, sf_dir):
    """AGG-32 by cosine distance."""
    rows = table(spark, sf_dir, "embeddings").withColumn("cluster_id", F.col("label").cast("int"))
    return spark.createDataFrame([(round(clustering.silhouette(rows, distance="cosine"), 6),)], "silhouette double")


@query("""
WITH RECURSIVE m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos),
v AS (SELECT CAST(label AS BIGINT) AS vec_id, list(x ORDER BY pos) AS v FROM m GROUP BY label),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) <= 0.95),
core AS (SELECT a AS node FROM near GROUP BY a HAVING count(*) + 1 >= 3),
reach AS (SELECT node, node AS other FROM core UNION SELECT r.node, n.b FROM reach r JOIN near n ON n.a = r.other WHERE n.b IN (SELECT node FROM core)),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
border AS (SELECT n.a AS node, min(c.component) AS component FROM near n JOIN comp c ON c.node = n.b GROUP BY n.a)
SELECT vec_id, coalesce(c.component, b.component, -1) AS cluster_id FROM v LEFT JOIN comp c ON c.node = vec_id LEFT JOIN border b ON b.node = vec_id""")
def density_of_labels(spark, sf_dir):
    """CLU-06: density clusters of the labels' mean vectors, in a wide neighbourhood."""
    means = clustering.chapter_vectors(table(spark, sf_dir, "embeddings"), "label").withColumn("vec_id", F.col("label").cast("long"))
    return clustering.density(means, 0.95, 3).select("vec_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query("""
WITH RECURSIVE v AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS vec_id, [x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE 1 - list_dot_product(a.v, b.v) <= 0.66),
core AS (SELECT a AS node FROM near GROUP BY a HAVING count(*) + 1 >= 4),
link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
reach AS (SELECT node, node AS other FROM core UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS MATERIALIZED (SELECT node, min(other) AS component FROM reach GROUP BY node),
border AS (SELECT n.a AS node, min(c.component) AS component FROM near n JOIN comp c ON c.node = n.b GROUP BY n.a)
SELECT vec_id, coalesce(c.component, b.component, -1) AS cluster_id FROM v LEFT JOIN comp c ON c.node = vec_id LEFT JOIN border b ON b.node = vec_id""")
def density_of_vectors(spark, sf_dir):
    """CLU-06: density clusters of all vectors, whatever their number; the sphere is wide, as the vectors have few near ones."""
    rows = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id").cast("long"))
    return clustering.density(rows, 0.66, 4, most=None).select("vec_id", "cluster_id")


@query()
def density_clusters(spark, sf_dir):
    """CLU-06: density and divisive clusters of the labels' mean vectors."""
    means = clustering.chapter_vectors(table(spark, sf_dir, "embeddings"), "label").withColumn("vec_id", F.col("label").cast("long"))
    dense = clustering.density(means, 0.6, 2).select("vec_id", F.col("cluster_id").alias("density_id"))
    return dense.join(clustering.bisecting(means, 3).select("vec_id", "cluster_id"), "vec_id")


@query("SELECT doc_id, 128 AS dimension, 1.0::DOUBLE AS norm FROM documents")
def passage_vectors(spark, sf_dir):
    """RET-01, RET-02, TOP-11, UDF-01: texts embedded in batches by the offline embedder."""
    return chunking.embed(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", F.size("embedding").alias("dimension"), F.round(V.norm(F.col("embedding")), 3).alias("norm"))


@query()
def chunk_summaries(spark, sf_dir):
    """CHK-08, UDF-02, SUM-01: a summary for each chunk of each level."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("chunk_index"), "text", F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"))
    return summarise.hierarchical(chunking.build_hierarchy(rows, "conv_id"), "conv_id").select("conv_id", "level", "chunk_index", "target_words", "summary")


@query("SELECT source || ' ' || lang AS line FROM documents WHERE length(source) + length(lang) >= 0 AND doc_id < 0 UNION ALL SELECT rpad(source, 10, ' ') || ' ' || CAST(n AS VARCHAR) FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def fixed_width_report(spark, sf_dir):
    """SNK-09."""
    counts = A.count_by(_docs(spark, sf_dir), "source")
    return reports.fixed_width(counts, {"source": 10, "n": 8}, "source")
