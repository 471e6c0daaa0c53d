"""Operators, on the cases that define them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import analytics as A
from corpuslab.operators import chunking, citations, clean, clustering, filters, joins, reports, retrieval, style, summarise


def ids(df):
    return [r["id"] for r in df.collect()]


def ranked(spark, names, ranker):
    return spark.createDataFrame([(n, ranker, i + 1) for i, n in enumerate(names)], "id string, ranker int, place int")


def test_rrf(spark):
    fused = retrieval.fuse([ranked(spark, "abc", 0), ranked(spark, "bd", 1)])
    assert ids(retrieval.best_fused(fused, 9)) == ["b", "a", "d", "c"]
    scores = {r["id"]: r["rrf"] for r in fused.collect()}
    assert scores["b"] == pytest.approx(1 / 62 + 1 / 61)
    tie = retrieval.fuse([ranked(spark, "a", 0), ranked(spark, "b", 1)])
    assert ids(retrieval.best_fused(tie, 9)) == ["a", "b"]


def corpus(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.2], 2)], "vec_id long, embedding array<double>, chapter int")
    texts = spark.createDataFrame([(0, "alpha beta", 1), (1, "beta", 1), (2, "gamma", 2)], "doc_id long, text string, chapter int")
    return vectors, texts, spark.createDataFrame([(2,)], "chapter int")


def test_overfetch_is_before_the_filter(spark):
    vectors, texts, chapters = corpus(spark)
    p = retrieval.Parameters(dense_wide=2, sparse_wide=2, rerank=False)
    args = (vectors, texts, chapters, [1.0, 0.0], ["beta"], "chapter", p)
    assert ids(retrieval.retrieve_passages(*args)) == []
    assert ids(retrieval.retrieve_passages(*args, prefilter=True)) == [2]
    merged = (vectors.withColumn("level", F.lit(1)), *args[1:])
    assert ids(retrieval.retrieve_passages(*merged, prefilter=True)) == []


def test_rerank_only_where_there_is_more(spark):
    candidates = spark.createDataFrame([("a", 0.2, 1), ("b", 0.1, 2)], "id string, rrf double, first_seen int")
    reverse = lambda df: df.withColumn("rerank_score", F.col("first_seen").cast("double"))
    assert ids(retrieval.rerank(candidates, reverse, 2)) == ["a", "b"]
    assert ids(retrieval.rerank(candidates, reverse, 1)) == ["b"]


def test_history_threshold(spark):
    log = spark.createDataFrame([(i, [s]) for i, s in enumerate((0.90, 0.80, 0.78, 0.7799, 0.79))], "id int, embedding array<double>")
    assert [round(r["score"], 4) for r in retrieval.similar_history(log, [1.0]).collect()] == [0.9, 0.8, 0.79]


def test_parameters():
    with pytest.raises(ValueError, match="chapters"):
        retrieval.Parameters(chapters=16)


def test_bm25_index_gives_the_same_scores(spark, tmp_path):
    _, texts, _ = corpus(spark)
    retrieval.bm25_index(texts, str(tmp_path / "bm25"))
    one = {r[0]: round(r[1], 9) for r in retrieval.bm25_scores(texts, ["beta", "nowhere"]).collect()}
    two = {r[0]: round(r[1], 9) for r in retrieval.bm25_from_index(spark, str(tmp_path / "bm25"), ["beta", "nowhere"]).collect()}
    assert one == two
    assert set(one) == {0, 1}


def test_plurality_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([("x", 5, 1), ("x", 3, 2), ("x", 3, 3), ("x", 5, 4)], "c string, k int, v int")
    assert A.plurality(df, ["c"], "k", "v").first()["k"] == 5


def test_rolling_is_over_rows(spark):
    df = spark.createDataFrame([("a", y, float(y)) for y in (2000, 2001, 2010, 2011, 2012)] + [("b", 1, 1.0)], "k string, y int, m double")
    out = {(r["k"], r["y"]): r["rolling"] for r in A.rolling_mean(df, ["k"], "y", "m").collect()}
    assert out["a", 2000] == pytest.approx((2000 + 2001 + 2010) / 3)
    assert out["b", 1] is None


def test_share_of_an_empty_year(spark):
    df = spark.createDataFrame([(1, "a", 0)], "year int, cluster string, n int")
    assert A.share_of_year(df).first()["pct"] == 0.0


def heads(spark, rows):
    return spark.createDataFrame(rows, "doc int, position int, text string, level int, page int, font_size double")


def test_heading_merges(spark):
    split = heads(spark, [(1, 0, "A long head-", 1, 1, 20.0), (1, 9, "ing", 1, 1, 20.2), (1, 20, "Next", 1, 2, 20.0)])
    assert [r["text"] for r in A.merge_split_headings(split, "doc").orderBy("position").collect()] == ["A long heading", "Next"]
    wrapped = heads(spark, [(1, 0, "Seeds", 1, 1, 20.0), (1, 9, "and reseeding", 1, 2, 20.0), (1, 12, "and more", 1, 2, 20.0), (1, 20, "Next", 1, 3, 20.0)])
    assert [r["text"] for r in A.merge_continuations(wrapped, "doc").orderBy("position").collect()] == ["Seeds and reseeding", "and more", "Next"]
    parts = heads(spark, [(1, 0, "Part I", 1, 1, 36.0), (1, 5, "On Groups", 1, 1, 36.0), (1, 9, "Introduction to Part I", 1, 2, 22.0), (1, 20, "Next", 1, 3, 22.0)])
    assert [r["text"] for r in A.collapse_parts(parts, "doc").orderBy("position").collect()] == ["Introduction to Part I: On Groups", "Next"]


def test_asof_and_intervals(spark):
    h = spark.createDataFrame([(1, 0, 1, "H1", 20.0), (1, 10, 2, "H2", 15.0), (1, 50, 1, "H1b", 20.0)], "doc int, position int, level int, text string, font_size double")
    p = spark.createDataFrame([(1, 0, 60), (1, 1, 20), (1, 2, 10)], "doc int, probe_id long, position int")
    out = {r["probe_id"]: (r["chapter"], r["section"]) for r in joins.heading_context(p, h, "doc").collect()}
    assert out == {0: ("H1b", None), 1: ("H1", "H2"), 2: ("H1", "H2")}
    pages = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20)], "doc int, page_number int, start_pos int, end_pos int")
    q = spark.createDataFrame([(1, 0, 10), (1, 1, 25), (1, 2, 9)], "doc int, probe_id long, position int")
    assert {r["probe_id"]: r["page_number"] for r in joins.page_of(q, pages, "doc").collect()} == {0: 2, 1: 2, 2: 1}


def test_two_tiers_and_fuzzy(spark):
    parsed = spark.createDataFrame([("Foo",), ("Chapter 2. Foo's Bar",), ("None",)], "title string")
    catalogue = spark.createDataFrame([("Foo", 1), ("Foos Bar", 2), ("Foo's bar", 3)], "title string, number int")
    out = {r["title"]: (r["number"], r["tier"]) for r in joins.two_tier(parsed, catalogue, "title", "number").collect()}
    assert out == {"Foo": (1, "exact"), "Chapter 2. Foo's Bar": (3, "normalised"), "None": (None, None)}
    index = spark.createDataFrame([("A study of group cognition in schools", 1), ("Silent knowing", 2), ("Designing for groups online today", 3)], "target string, position int")
    asked = spark.createDataFrame([("Silent knowing",), ("A study of group cognition",), ("groups online designing for today",), ("nothing",)], "title string")
    got = {r["title"]: (r["position"], r["tier"]) for r in joins.fuzzy_lookup(asked, index, "title", "target").collect()}
    assert got == {"Silent knowing": (2, 1), "A study of group cognition": (1, 2), "groups online designing for today": (3, 3)}


def test_greedy_pairs(spark):
    a = spark.createDataFrame([(1, "aaaa"), (1, "aabb")], "block int, a string")
    b = spark.createDataFrame([(1, "aaab"), (1, "aaaa")], "block int, b string")
    assert {(r["a"], r["b"]) for r in joins.greedy_pairs(a, b, "block", "a", "b").collect()} == {("aaaa", "aaaa"), ("aabb", "aaab")}


def test_sections_that_may_be_chapters(spark):
    rows = [("Overview", "x" * 40), ("Book 3: All", "x" * 40), ("The whole book", "x" * 40), ("A chapter", "x" * 40), ("Another", "short")]
    df = spark.createDataFrame([(*r, "The Whole Book") for r in rows], "title string, body string, book string")
    assert [r["title"] for r in joins.chapter_sections(df, "title", "body", "book").collect()] == ["A chapter"]


def test_issue_join_keeps_filled_texts(spark):
    e = spark.createDataFrame([(1, 2, None), (1, 3, "own")], "volume int, issue int, text string")
    c = spark.createDataFrame([("1(2): Title", "chapter"), ("1(3): Other", "chapter")], "title string, text string")
    assert {r["issue"]: r["text"] for r in joins.by_issue(e, c, "title").collect()} == {2: "chapter", 3: "own"}


def test_bibliography(spark):
    lines = ["A (2001). x", "B (2002). y", "plain", "plain"]
    df = spark.createDataFrame([("\n".join(lines),), ("\n".join([*lines[:3], "C, pp. 3"]),), ("A (2001)",)], "t string")
    assert [r[0] for r in df.select(filters.is_bibliography(F.col("t"))).collect()] == [False, True, False]


def cleaned(spark, text, step=clean.clean):
    return spark.createDataFrame([(text,)], "t string").select(step(F.col("t"))).first()[0]


def test_cleaning_steps(spark):
    assert cleaned(spark, "a\nBook Title\n  \n 12 \nb", clean.strip_running_headers) == "a\nb"
    assert cleaned(spark, "text\n References \nA (2001)", clean.strip_references) == "text"
    assert cleaned(spark, "x\n10 \nAnnB: \nhello\ny", clean.join_turns) == "x\n10 AnnB: hello\ny"
    two, three = "1 a: x\n2 b: y\nprose", "1 a: x\n2 b: y\n3 c: z\nprose"
    assert cleaned(spark, two, clean.strip_turn_runs) == two
    assert cleaned(spark, three, clean.strip_turn_runs) == "prose"
    prose = "Then, narrative resumes here with a long enough line of text."
    assert cleaned(spark, f"before\nLog 3-1.\nhm hi\n{prose}", clean.strip_logs) == f"before\n{prose}"
    # a line that begins with a plain word and a blank looks like a turn's name: the block goes to its end
    assert cleaned(spark, "before\nLog 3.\nNarrative resumes here with a long enough line.", clean.strip_logs) == "before\n"
    assert cleaned(spark, "a\nFigure 3. Caption here\nb", clean.strip_captions) == "a\n\nb"
    assert cleaned(spark, "a\n 12 \nb", clean.strip_page_numbers).replace("\n", "") == "ab"
    note = 'text\n\n1 Miller, J. (1999), p. 3, Press\n\nmore'
    assert "Miller" not in cleaned(spark, note, clean.strip_footnotes)
    assert "Miller" in cleaned(spark, "text\n\n1 Miller came\n\nmore", clean.strip_footnotes)
    assert cleaned(spark, "a  \t b \n\n\n\n c ", clean.normalise_space) == "a b\n\nc"


def test_cleaning_twice_changes_nothing_more(spark):
    once = cleaned(spark, "A line.\n\n1 Miller, J. (1999), p. 3, Press\n\n12\nmore text\n References \nx")
    assert cleaned(spark, once) == once


def test_style(spark):
    df = spark.createDataFrame([(1, "Perhaps it must be so. Why? It is ab:c 1:2; I was really asked.", 12), (2, "", 0), (3, "a a b c aa aa bb cc", 8)], "id int, text string, words long")
    rows = {r["id"]: r for r in style.features(df).collect()}
    assert set(style.METRICS) <= set(rows[1].asDict())
    assert len(style.METRICS) == 31
    assert rows[1]["colon_per_1k"] == pytest.approx(1 / 0.012, abs=1e-3)
    assert rows[1]["hedge_assert_ratio"] == 0.5
    assert rows[1]["passive_per_1k"] > 0
    assert rows[1]["sent_count"] == 3
    assert rows[2]["hedge_assert_ratio"] == 0.5
    assert rows[2]["ttr"] == 0.0
    assert rows[3]["hapax_ratio"] == 0.5  # aa twice, bb and cc once


def test_chunks_are_found_in_the_text():
    text = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(12))
    found = chunking.located(text)
    assert len(found) > 3
    assert all(text[c["start_offset"] : c["end_offset"]] == c["text"] and len(c["text"]) <= 1000 for c in found)
    assert chunking.located(" ") == []
    assert max(map(len, chunking.split_text("x" * 2500))) <= 1000


def test_citations():
    assert [c["cited_year"] for c in citations.inline_citations("x (Ander, 2006) y", "Ander")] == [2006]
    assert len(citations.inline_citations("x (Ander, 2006) y", "Ander", compat=True)) == 2
    assert citations.inline_citations("Ander, G. (2006). Title", "Ander") == []
    both = citations.inline_citations("Ander (2001) and (Bell & Ander, 2002b); Ander et al., 1900", "Ander")
    assert sorted((c["cited_year"], c["suffix"]) for c in both) == [(2001, ""), (2002, "b")]


def test_resolution(spark):
    entry = "Ander, G. (2006). "
    texts = {1: entry + "A title here now. MIT Press.\n" + entry + "Other. J.", 2: entry + "A work. MIT Press.", 3: "Ander, G. (2001). X. Y.", 4: "nothing", 5: entry + "A study of groups at work. In X (Ed.)", 6: entry + "Far away things indeed. In X (Ed.)", 7: entry + "Far. Journal."}
    chunks = spark.createDataFrame([(b, 1, t) for b, t in texts.items()], "book int, chapter int, text string")
    asked = spark.createDataFrame([(b, b, 1, 2006) for b in texts], "citation_id int, book int, chapter int, cited_year int")
    library = spark.createDataFrame([("A study of groups at work", 1, 9, 4)], "title string, position int, to_book int, to_chapter int")
    out = {r["citation_id"]: r for r in citations.resolve(asked, chunks, library, "Ander").collect()}
    assert {k: r["unresolved_reason"] for k, r in out.items()} == {
        1: "ambiguous_year", 2: "cited_whole_book", 3: "year_not_in_ref_list", 4: "no_ref_list_in_book", 5: None, 6: "chapter_title_not_in_library", 7: "cited_article_not_in_library",
    }
    assert (out[5]["to_book"], out[5]["to_chapter"], out[5]["resolved"]) == (9, 4, True)


def test_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(3)[i % 3] + rng.normal(0, 0.02, 3)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assigned, centers, cost = clustering.kmeans(df, k=3, starts=2, max_iter=20)
    assert sorted(r["count"] for r in assigned.groupBy("cluster_id").count().collect()) == [20, 20, 20]
    assert cost < 1
    assert all(abs(np.linalg.norm(c) - 1) < 1e-9 for c in centers)
    assert clustering.silhouette(assigned) > 0.9
    dense = clustering.density(df.union(spark.createDataFrame([(99, [-1.0, -1.0, -1.0])], df.schema)), 0.1, 3)
    assert sorted(r["count"] for r in dense.groupBy("cluster_id").count().collect()) == [1, 20, 20, 20]
    assert clustering.parse_label("LABEL: Groups\nEXPLANATION: why", 3) == ("Groups", "why")
    assert clustering.parse_label(None, 3) == ("Cluster 3", "")


def test_summaries(spark):
    rows = spark.createDataFrame([(1, i, f"First {i}. Second {i}. Third.") for i in range(8)], "k int, pos int, text string")
    out = summarise.key_sentences(rows, ["k"], "pos", "text").first()["summary"].split("\n\n")
    assert [x.split(".")[0] for x in out] == ["First 0", "First 1", "First 4", "First 5", "First 6", "First 7"]
    long = spark.createDataFrame([("one two three four five six seven eight nine. ten eleven twelve thirteen fourteen fifteen",), ("short",)], "t string")
    assert [r[0] for r in long.select(summarise.guard_length(F.col("t"), 8)).collect()] == ["one two three four five six seven eight nine.", "short"]
    levels = summarise.three_levels(spark.createDataFrame([("d", "s", 1, "a b c"), ("d", "s", 2, "d e")], "doc string, sec string, pos int, text string"), "sec", "doc", "pos", "text", (2, 3, 4))
    assert levels["document"].first()["summary"] == "a b... d..."


def test_length_guard_at_exactly_seventy_per_cent(spark):
    at = lambda stop: " ".join(["a" * 9] * 6 + ["b" * (stop - 61) + "."] + ["c"] * 4 + ["d" * (81 - stop)] + ["e"] * 2)
    long = spark.createDataFrame([(at(64),), (at(65),)], "t string")
    # the first twelve words have 90 characters, of which 63 are 70 %
    assert [r[0][-4:] for r in long.select(summarise.guard_length(F.col("t"), 10)).collect()] == ["c...", "bbb."]


def test_reports(spark):
    text = "Title\n=====\nPART ONE\n=====\nChapter 1: Alpha\n=====\n" + "Body of alpha with words.\nAnd a second line that is long enough.\nKeywords: x, y\n" + "=====\nOther\nBody of other, long enough to count as one.\n"
    got = reports.report_sections(text)
    assert got[0][0] == "Chapter 1: Alpha"
    assert got[0][2] == ["x", "y"]
    assert got[1][0] == "Other"
    df = spark.createDataFrame([(1, "Chapter 1: A\n-----\nbody a\nKeywords: k\nCHAPTER II: B\nbody b\nChapter 1. again\nmore a\n\nOVERVIEW\nall in all")], "k int, t string")
    assert {r["chapter"]: r["text"] for r in reports.chapter_texts(df, "k", "t").collect()} == {1: "body a\n\nmore a", 2: "body b", 0: "all in all"}
    assert reports.overview_after_separator("x\n=====\nBOOK OVERVIEW\n\n-----\nthe text") == "the text"
    assert reports.numbered_chapters("head\n=====\n1. A title\n   wrapped\n-----\nbody\n\nmore\n2. B\n-----\nb\n=====\nx") == [{"title": "A title wrapped", "paragraphs": ["body", "more"]}, {"title": "B", "paragraphs": ["b"]}]
    html = spark.createDataFrame([("a<h1>X</h1>b<hr>c<h1>Y</h1>d",)], "h string")
    assert html.select(reports.insert_before(F.col("h"), "<h1>Y", F.lit("!"))).first()[0] == "a<h1>X</h1>b<hr>c!<h1>Y</h1>d"
    assert html.select(reports.replace_between(F.col("h"), "<h1>X</h1>", "<hr>", F.lit("Z"))).first()[0] == "a<h1>X</h1>Z<hr>c<h1>Y</h1>d"
    assert html.select(reports.move_section(F.col("h"), "<h1>X", "<hr>", "<h1>Y")).first()[0] == "a<hr>c<h1>X</h1>b<h1>Y</h1>d"
    nested = spark.createDataFrame([("n", ("w1 " * 12, "p"))], "name string, s struct<body_text:string,other:string>")
    row = reports.truncated(nested).first()
    assert len(row["s"]["body_text"].split()) == 10
    assert reports.status_page("new", "old\n## Notes\nmine") == "new\n\n## Notes\nmine"
    stems = reports.prompts(spark.createDataFrame([("1.first, tell\n\n2.second say",)], "t string"), "t")
    assert {r["stem"] for r in stems.collect()} == {"1.first", "2.second"}


def test_texts_are_split_once_and_not_moved(spark):
    """Scores read the texts once; the texts of hits are found by the hits' ids, without a shuffle or sort of the table."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>", useArrow=False)
    def counted(t):
        seen.add(1)
        return t.split()

    docs = spark.createDataFrame([(i, f"alpha w{i}. Beta {i % 3}.") for i in range(30)], "doc_id long, text string").repartition(3)
    scored = retrieval.bm25_scores(docs, ["alpha", "Beta"], terms=lambda c: counted(c))
    assert scored.count() == 30
    assert seen.value == 30
    hits = spark.createDataFrame([(3, 0), (5, 1), (99, 2)], "id long, first_seen int")
    for found in (retrieval.with_texts(hits, docs, "doc_id"), retrieval.overlap_scorer(docs, ["alpha"])(hits)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi, BuildRight" in plan
        assert sorted(r["id"] for r in found.collect()) == [3, 5, 99]
    split = spark.sparkContext.accumulator(0)
    texts = docs.select("doc_id", F.udf(lambda t: split.add(1) or t, "string", useArrow=False)("text").alias("text"))
    assert retrieval.extractive_answer(["beta"], retrieval.with_texts(hits, texts, "doc_id"), "first_seen").first()["answer"] == "Beta 0. Beta 2."


def test_a_question_alone_builds_no_index(spark, tmp_path):
    spark.createDataFrame([(i, f"red w{i}") for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    scan = spark.read.parquet(str(tmp_path / "d"))
    assert retrieval.ready_index(scan) is None
    folder = retrieval.stored_index(scan, scan)
    assert retrieval.ready_index(scan) == folder
    spark.createDataFrame([(9, "red")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "d"))
    assert retrieval.ready_index(spark.read.parquet(str(tmp_path / "d"))) is None


def test_kmeans_starts_run_together(spark, monkeypatch):
    """All starts are at work at the same time, over one cached table that is released, and the best is taken."""
    import threading

    from pyspark.ml.clustering import KMeans

    together, own = threading.Barrier(3, timeout=60), KMeans.fit
    monkeypatch.setattr(clustering.KMeans, "fit", lambda self, points: (together.wait(), own(self, points))[1])
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2]) for i in range(12)], "vec_id long, embedding array<double>")
    assigned, centers, cost = clustering.kmeans(rows, k=2, starts=3)
    assert sorted(r["count"] for r in assigned.groupBy("cluster_id").count().collect()) == [6, 6]
    assert len(centers) == 2 and cost < 1e-9
