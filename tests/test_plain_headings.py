"""Operators on headings, titles and positions against plain loops, over random rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import analytics as A
from corpuslab.operators import chunking, filters, joins

HEADING = "doc int, position int, text string, level int, page int, font_size double"
WORDS = ("Groups", "seeds and", "reseeding", "inter-", "-ing", "élan", "Élan", "Part I", "Part 2 ", "part II", "Introduction to Part I", "Introduction  to Part 2", "On Groups", "Preface", "ab", "Notes on Y", "A whole sentence that was set in a large size by some accident.", "x" * 151)


def headings(seed, docs=40):
    rng = random.Random(seed)
    rows = []
    for doc in range(docs):
        page, place = 1, 0
        for _ in range(rng.randint(0, 14)):
            page += rng.choice((0, 0, 0, 1, 2))
            place += rng.randint(1, 50)
            rows.append((doc, place, rng.choice(WORDS), rng.choice((1, 1, 2)), page, rng.choice((12.0, 20.0, 20.25, 20.5, 20.75, 22.0))))
    return rows


def of_doc(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(list(r))
    return out


def ordered(df):
    return sorted(tuple(r[c] for c in ("doc", "position", "text")) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_split_headings(spark, seed):
    rows, want = headings(seed), []
    for own in of_doc(rows).values():
        done = []
        for h in own:
            if done and done[-1][3:5] == h[3:5] and abs(done[-1][5] - h[5]) < 0.5:
                done[-1][2] = done[-1][2][:-1] + h[2] if done[-1][2].endswith("-") else f"{done[-1][2]} {h[2]}"
            else:
                done.append(h)
        want += [tuple(h[:3]) for h in done]
    got = A.merge_split_headings(spark.createDataFrame(rows, HEADING), "doc")
    assert ordered(got) == sorted(want)
    assert len(want) < len(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_continued_headings(spark, seed):
    rows, want = headings(seed), []
    for own in of_doc(rows).values():
        i = 0
        while i < len(own):
            h, after = own[i], own[i + 1] if i + 1 < len(own) else None
            if after and after[4] <= h[4] + 1 and after[2][0].islower() and abs(after[5] - h[5]) < 2:
                want.append((h[0], h[1], h[2] + ("" if h[2].endswith("-") else " ") + after[2]))
                i += 2
            else:
                want.append(tuple(h[:3]))
                i += 1
    assert ordered(A.merge_continuations(spark.createDataFrame(rows, HEADING), "doc")) == sorted(want)
    assert len(want) < len(rows)


def test_part_headings(spark):
    rng = random.Random(6)
    rows, want = [], []
    for doc in range(60):
        texts = []
        for _ in range(rng.randint(0, 6)):
            texts += rng.choice((["Part I", "On Groups", "Introduction to Part I"], ["Part iv ", "Work", "Introduction  to  Part iv "], ["Part 2", "Introduction to Part 2"], ["Part One", "x", "Introduction to Part 1"], ["Groups"], ["Part V"]))
        rows += [(doc, i, t, 1, 1, 20.0) for i, t in enumerate(texts)]
        i = 0
        while i < len(texts):
            if re.match(r"Part\s+(?:[IVXivx]+|\d+)\s*$", texts[i]) and i + 2 < len(texts) and re.match(r"Introduction\s+to\s+Part\s+(?:[IVXivx]+|\d+)\s*$", texts[i + 2]):
                want.append((doc, i, f"{texts[i + 2].strip()}: {texts[i + 1].strip()}"))
                i += 3
            else:
                want.append((doc, i, texts[i]))
                i += 1
    assert ordered(A.collapse_parts(spark.createDataFrame(rows, HEADING), "doc")) == sorted(want)
    assert len(want) < len(rows)


def test_chapter_headings(spark):
    rows = headings(7)
    allowed = {(d, t) for d in range(0, 40, 3) for t in ("preface", "notes on y")}
    df, known = spark.createDataFrame(rows, HEADING), spark.createDataFrame(sorted(allowed), "doc int, allowed_title string")
    plain = spark.createDataFrame([(w,) for w in WORDS], "t string").select("t", T.is_excluded_title(F.col("t")).alias("out")).collect()
    excluded = {r["t"] for r in plain if r["out"]}
    assert {"Preface", "Notes on Y"} <= excluded
    fits = lambda r: r[3] == 1 and r[5] >= 13 and not (r[2].strip().endswith(".") and len(r[2].strip()) > 50)
    want = [r[:3] for r in rows if fits(r) and (r[2] not in excluded or (r[0], r[2].strip().lower()) in allowed)]
    assert ordered(filters.chapter_heading(1, 13.0, known)(df)) == sorted(want)
    assert ordered(filters.chapter_heading(1, 13.0)(df)) == sorted(r[:3] for r in rows if fits(r) and r[2] not in excluded)
    like = [r[:3] for r in rows if len(r[2]) <= 150 and len(r[2].strip()) > 2 and r[5] >= 13]
    assert ordered(df.filter(filters.heading_like(F.col("text"), F.col("font_size")))) == sorted(like)


def test_two_tiers(spark):
    rng = random.Random(8)
    forms = ("Foo", "Foo's Bar", "Foos Bar", "Chapter 2. Foos Bar", " Foo ", "foo", "On  work", "3. On work", "Élan", "12. Élan by Jo Doe")
    catalogue = [(rng.choice(forms[::2]), n) for n in range(30)]
    parsed = [(i, rng.choice((*forms, "Nowhere"))) for i in range(60)]
    normal = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in (*forms, "Nowhere")], "t string").select("t", T.normalise_title(F.col("t")).alias("n")).collect()}
    exact, loose = {}, {}
    for title, number in catalogue:  # the last counts
        exact[title.strip()], loose[normal[title]] = number, number
    got = joins.two_tier(spark.createDataFrame(parsed, "id int, title string"), spark.createDataFrame(catalogue, "title string, number int"), "title", "number").collect()
    assert len(got) == len(parsed)
    for r in got:
        if (title := r["title"].strip()) in exact:
            assert (r["number"], r["tier"]) == (exact[title], "exact")
        elif normal[r["title"]] in loose:
            assert (r["number"], r["tier"]) == (loose[normal[r["title"]]], "normalised")
        else:
            assert (r["number"], r["tier"]) == (None, None)
    assert {r["tier"] for r in got} == {"exact", "normalised", None}


def test_issues(spark):
    rng = random.Random(9)
    issues = [(v, i) for v in range(1, 12) for i in range(1, 5)]
    editorials = [(v, i, rng.choice((None, "", "  ", "own text"))) for v, i in issues]
    named = rng.sample(issues, 30)
    chapters = [(rng.choice((f"{v}({i}): A title", f" {v} ({i}) : B")), f"text {v}.{i}") for v, i in named] + [("No issue", "none"), ("3(x): odd", "none"), ("About 3(2): late", "none")]
    got = {(r["volume"], r["issue"]): r["text"] for r in joins.by_issue(spark.createDataFrame(editorials, "volume int, issue int, text string"), spark.createDataFrame(chapters, "title string, text string"), "title").collect()}
    assert len(got) == len(issues)
    for v, i, text in editorials:
        if text and text.strip():
            assert got[v, i] == text
        elif (v, i) in named:
            assert got[v, i] == f"text {v}.{i}"
        else:
            assert not (got[v, i] or "").strip()


def test_heading_of_a_position(spark):
    rng = random.Random(10)
    rows = headings(11)
    probes = [(doc, n, rng.randint(0, 500)) for doc in range(42) for n in range(6)]
    got = {(r["doc"], r["probe_id"]): (r["chapter"], r["section"]) for r in joins.heading_context(spark.createDataFrame(probes, "doc int, probe_id int, position int"), spark.createDataFrame(rows, HEADING), "doc", least_font=13.0).collect()}
    own = of_doc(rows)
    for doc, n, position in probes:
        chapter = section = None
        for h in own.get(doc, []):
            if h[1] > position:
                break
            if h[3] == 1 and h[5] >= 13:
                chapter, section = h[2], None
            elif h[3] == 2:
                section = h[2]
        assert got[doc, n] == (chapter, section)


def test_page_of_a_position(spark):
    rng = random.Random(12)
    pages, probes = [], []
    for doc in range(30):
        at = 0
        for number in range(1, rng.randint(1, 9)):
            at += rng.choice((0, 0, 5))  # a gap between pages
            pages.append((doc, number, at, at + rng.randint(1, 60)))
            at = pages[-1][3]
        probes += [(doc, n, rng.randint(0, 400)) for n in range(8)]
    got = {(r["doc"], r["probe_id"]): r["page_number"] for r in joins.page_of(spark.createDataFrame(probes, "doc int, probe_id int, position int"), spark.createDataFrame(pages, "doc int, page_number int, start_pos int, end_pos int"), "doc").collect()}
    for doc, n, position in probes:
        own = [p for p in pages if p[0] == doc]
        inside = [p[1] for p in own if p[2] <= position < p[3]]
        assert got[doc, n] == (inside[0] if inside else own[-1][1] if own else 1)


def test_embedded_texts(spark):
    """Signed counts of words and their trigrams in 128 places, unit length, the prefix among them."""
    texts = ["Groups at work", "a ab abc", "", None, "Élan élan " * 40]
    rows = [*enumerate(texts), *((100 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect())]
    got = {r["id"]: np.array(r["embedding"]) for r in chunking.embed(spark.createDataFrame(rows, "id long, text string"), ["id"]).collect()}
    for key, text in rows:
        want = np.zeros(128)
        for word in ("passage: " + (text or "")).lower().split():
            for part in [word] + [word[i : i + 3] for i in range(len(word) - 2)]:
                h = zlib.crc32(part.encode())
                want[h % 128] += 1 if h >> 31 else -1
        assert got[key] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
