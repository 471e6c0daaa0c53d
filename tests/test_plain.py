"""Operators on texts against plain Python, row by row, over whole tables and over made texts of many kinds."""

import difflib
import html
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import fuzzy
from corpuslab.functions import text as T
from corpuslab.operators import chunking, clean, clustering, style
from corpuslab.plans import catalog

SF = "/root/testdata/sf0.001"
NOTE = "1 Miller, J. (1999), p. 3, Press"
PIECES = (
    "Then, narrative goes on for quite a few words in one long line of text.", "A plain line of prose that is long enough to be one, with a comma.", "short", "", "   ", "12", " 345 ", "20001",
    "Book Title\n  \n 12 ", "Another Running Head\n\t\n\t7\t", "Log 3-1.", "LOG 12.", "10 \nAnnB: \nhello there", "11\nBob: said it", "1 a: x", "2 b: y", "3. c: z", "4 12:30 d", "Figure 3. Caption", "Table 2-1 of numbers",
    f"\n{NOTE}\n", "\n2 Miller came\n", "\n3 \"Quoted\" Trans. University Press, Journal, 2001\n", "Ends\twith \t tabs", "Bob: a name before a long enough line of prose here", "References to others in a line", "Fig. 4 shows",
)


def made_texts(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lines = [rng.choice(PIECES) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.2:
            lines.insert(rng.randint(0, len(lines)), " References ")
        out.append("\n".join(lines))
    return [*out, "", "x", "\n\n"]


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def plain_clean(text):
    for pattern, by in ((clean.RUNNING_HEADER, "\n"), (clean.REFERENCES, ""), (clean.THREE_LINE_TURN, r"\1\2\3"), (clean.TWO_LINE_TURN, r"\1\2")):
        text = re.sub(pattern, by, text)
    first, *logs = re.split(clean.LOG_LABEL, text)
    for log in logs:
        lines = log.split("\n")
        while lines and not (re.search(clean.PROSE_LINE, lines[0].strip()) and not re.search(clean.NAME_LINE, lines[0].strip())):
            lines.pop(0)
        first += "\n" + "\n".join(lines)
    kept, run = [], []
    for line in [*first.split("\n"), None]:
        if line is not None and re.search(clean.TURN_LINE, line):
            run.append(line)
            continue
        kept += run if len(run) < 3 else []
        run = []
        kept += [line] if line is not None else []
    text = re.sub(clean.PAGE_NUMBER, "", re.sub(clean.CAPTION, "\n", "\n".join(kept)))
    blocks = re.split(r"\n[ \t]*\n", text)
    for i, block in enumerate(blocks):
        if i and re.match(clean.FOOTNOTE_START, block) and len(re.findall(clean.FOOTNOTE_MARK, block)) >= 2:
            blocks[i] = ""
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "\n\n".join(blocks)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def test_cleaning(spark):
    rows = [*documents(spark), *((-1 - i, t) for i, t in enumerate(made_texts()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", clean.clean(F.col("text")).alias("c")).collect()}
    for key, text in rows:
        assert got[key] == plain_clean(text), text
    assert sum(got[k] != t for k, t in rows) > 250


def test_runs_of_turns(spark):
    """Runs of every length at every place, and one of very many lines."""
    rng = random.Random(8)
    turns, other = ("1 a: x", "22. Bo (y", "3 12:30 d", "4 c:"), ("prose", "", "1 2 3", "1234 a: x", " 1 a: x")
    texts = ["\n".join(line for _ in range(rng.randint(0, 6)) for line in rng.choices(rng.choice((turns, other)), k=rng.randint(1, 5))) for _ in range(300)]
    texts += ["before\n" + "7 name: words\n" * 200_000 + "after", "\n".join(["8 n: w"] * 100_000), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["c"] for r in df.select("id", clean.strip_turn_runs(F.col("t")).alias("c")).collect()}
    for i, text in enumerate(texts[:-1]):
        kept, run = [], []
        for line in text.split("\n"):
            if re.search(clean.TURN_LINE, line):
                run.append(line)
                continue
            kept += [*(run if len(run) < clean.LEAST_RUN else []), line]
            run = []
        assert got[i] == "\n".join(kept + (run if len(run) < clean.LEAST_RUN else [])), text[:200]
    assert got[len(texts) - 1] is None


def test_cleaned_texts_are_those_of_50_words(spark):
    got = {r["doc_id"]: r["narrative_words"] for r in catalog.queries()["cleaned_texts"](spark, SF).collect()}
    words = {k: len(plain_clean(t).split()) for k, t in documents(spark)}
    assert got == {k: n for k, n in words.items() if n >= 50}


def plain_style(text, words):
    sents = fuzzy.split_sentences(text)
    lengths = [len(re.findall(r"\S+", s, re.A)) for s in sents]
    tokens = re.findall(r"\b[a-zA-Z'\-]{2,}\b", text)
    low = [t.lower() for t in tokens]
    vowels = [max(1, len(re.findall("[aeiouy]+", t[:-1] if len(t) > 2 and re.search("[^aeiouy]e$", t) else t))) for t in low]
    n, m = len(sents), len(tokens)
    out = dict.fromkeys(style.METRICS, 0.0) | {"sent_count": n, "hedge_assert_ratio": 0.5}
    if n:
        out |= {
            "sent_mean_words": sum(lengths) / n, "sent_std_words": statistics.pstdev(lengths), "sent_pct_long": 100 * sum(x > 30 for x in lengths) / n, "sent_pct_short": 100 * sum(x < 10 for x in lengths) / n,
            "pct_questions": 100 * sum(s.endswith("?") for s in sents) / n,
        }
    if n and m:
        hard = 100 * sum(v >= 3 for v in vowels) / m
        out |= {"flesch_ease": 206.835 - 1.015 * m / n - 84.6 * sum(vowels) / m, "fk_grade": 0.39 * m / n + 11.8 * sum(vowels) / m - 15.59, "fog_index": 0.4 * (m / n + hard)}
    if m:
        out |= {"ttr": len(set(low)) / m, "mean_word_len": sum(map(len, low)) / m, "abstract_ratio": sum(bool(re.search(style.ABSTRACT, t)) for t in low) / m, "hapax_ratio": sum(low.count(t) == 1 for t in set(low)) / m}
    if words:
        found = {k: len(re.findall(p.replace("{name}", "Ander"), text)) for k, p in style.RATES.items()}
        out |= {k: v / (words / 1000) for k, v in found.items()}
        h, a = found["hedge_per_1k"], found["assert_per_1k"]
        out["hedge_assert_ratio"] = h / (h + a) if h + a else 0.5
    return out


STYLES = (
    "Perhaps it must be so. Why? It is ab:c 1:2; I was really asked. Dr. Lee (Ander et al., 2001a) clearly showed this; however, we were told otherwise.",
    "This paper argues that groups matter -- for example, in order to learn. That is to say: nothing. Ander (1999) means it! Although unclear, it seems likely—thus we stop.",
    "one", "", "No end here and although it might", "A 'quoted' well-known don't. We. Us? \"Yes,\" I said. 3 of 4. The activity, the establishment and the creativity were quickly noted.",
)


def test_style(spark):
    rng = random.Random(5)
    rows = [(k, t) for k, t in documents(spark) if len(t) < 20_000] + [(-1 - i, t) for i, t in enumerate(STYLES)]
    rows += [(-100 - i, " ".join(rng.choice(STYLES) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    df = spark.createDataFrame([(k, t, len(re.findall(r"\S+", t, re.A))) for k, t in rows], "doc_id long, text string, words long")
    got = {r["doc_id"]: r for r in style.features(df).collect()}
    digits = {"sent_count": 0, "ttr": 4, "abstract_ratio": 4, "hapax_ratio": 4, "hedge_assert_ratio": 4, "mean_word_len": 3, **dict.fromkeys(style.RATES, 3)}
    for key, text in rows:
        want = plain_style(text, len(re.findall(r"\S+", text, re.A)))
        for name, value in want.items():
            assert got[key][name] == pytest.approx(value, abs=0.51 * 10 ** -digits.get(name, 2)), (name, text[:200])


def test_sentences_of_known_number(spark):
    rng = random.Random(9)
    whole = ("We met Dr. Lee at noon.", "Why?", "It was, e.g. by Mr. Smith, told!", "\"Really?\"", "See Fig. 3 and pp. 4 of it.", "A. N. Other wrote 3.5 pages.", "Ünal came (at last).", "No!", "The end of vol. 2 was cf. Lee lost.")
    rows = [(i, [rng.choice(whole) for _ in range(rng.randint(0, 30))]) for i in range(200)]
    blank = lambda: rng.choice((" ", "  ", "\n", "\n\n", "\t"))
    df = spark.createDataFrame([(i, "".join(s + blank() for s in own)) for i, own in rows], "id int, text string")
    got = {r["id"]: r["s"] for r in df.select("id", fuzzy.sentences("text").alias("s")).collect()}
    assert got == dict(rows)


def test_chunks_cover_the_texts(spark):
    chunks = {}
    for r in catalog.queries()["chunked_documents"](spark, SF).collect():
        chunks.setdefault(r["doc_id"], []).append(r)
    for key, text in documents(spark):
        own = sorted(chunks.get(key, []), key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in own] == list(range(len(own)))
        assert bool(own) == bool(text.strip())
        covered = bytearray(len(text))
        for r in own:
            piece = text[r["start_offset"] : r["end_offset"]]
            assert piece == r["text"] == piece.strip()
            assert len(piece) <= chunking.CHUNK_SIZE
            assert r["word_count"] == len(piece.split())
            covered[r["start_offset"] : r["end_offset"]] = b"\1" * len(piece)
        if all(text.count(r["text"]) == 1 for r in own):  # a piece that occurs again is found at the first place behind the last start
            assert all(covered[i] or c.isspace() for i, c in enumerate(text))


def test_hierarchies_keep_the_texts(spark):
    levels = {}
    for r in catalog.queries()["chunk_hierarchy"](spark, SF).collect():
        levels.setdefault((r["conv_id"], r["level"]), []).append(r)
    for (key, _), own in levels.items():
        joined = "\n\n".join(r["text"] for r in sorted(own, key=lambda r: r["chunk_index"]))
        base = "\n\n".join(r["text"] for r in sorted(levels[key, 0], key=lambda r: r["chunk_index"]))
        assert joined == base


def plain_title(title):
    """Word by word where the operator uses one expression a step."""
    number = r"(?:[ivxlcdm]+|\d+)"
    title = title.strip()
    for pattern in (rf"(?:chapter|part|section)\s+{number}[.:\s–-]+", r"\d+[.:\s]+", r"[ivxlcdm]+[.:\s]+", rf"introduction\s+to\s+part\s+{number}[\s.:–-]+"):
        if m := re.match(pattern, title, re.I):
            title = title[m.end() :].strip()
    if m := re.search(r"\s+by\s+[A-ZÀ-ɏ].", title):
        title = title[: m.start()].strip()
    return " ".join(re.sub("['’‘]", "", title.lower()).split())


def test_titles(spark):
    rng = random.Random(1)
    heads = ("", "Chapter 3: ", "chapter IV. ", "12. ", "XII ", "Part 2 – ", "Section  7. ", "Introduction to Part I: ", "iv. ", "Chapters ")
    bodies = ("Groups at Work", "Foo’s  Bar", "Deep 'thought' here", "Notes on Y", "Introduction", "mix of things", "by the sea", "References", "Preface", "Contents .......... 4", "Abstracts", "Note", "The Vita")
    tails = ("", " by Jane Doe", " by Éva Nagy and others", " by hand", "  ", " …", ".")
    titles = sorted({rng.choice(heads) + rng.choice(bodies) + rng.choice(tails) for _ in range(600)})
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    rows = df.select("t", T.normalise_title(F.col("t")).alias("form"), T.is_excluded_title(F.col("t")).alias("out"), T.safe_filename(F.col("t")).alias("file")).collect()
    for r in rows:
        assert r["form"] == plain_title(r["t"])
        low = re.sub(r"[\s.…]+$", "", r["t"].strip().lower())
        both = {low, re.sub("['’‘]", "", low)}
        listed = {*T.EXCLUDED_EXACT, *T.EXCLUDED_PREFIX, *(p + "s" for p in T.EXCLUDED_PREFIX)}
        assert r["out"] == (bool(both & listed) or any(x.startswith(p + " ") for x in both for p in T.EXCLUDED_PREFIX) or "..." in r["t"]), r["t"]
        assert r["file"] == "_".join(re.sub(r"[^\w\s-]", "", r["t"], flags=re.A).strip().split())[:70]


def test_identifiers_and_lists(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        doi, tail = f"10.{rng.randint(1000, 99999)}/a{rng.randrange(10**6)}", rng.choice(("", ".", ",", ".;", " x", '"'))
        words = [rng.choice(("group work", "learning", "e-science", "CSCL")) for _ in range(rng.randint(1, 5))]
        rows.append((i, rng.choice(("see ", "https://doi.org/", "doi:")) + doi + tail, doi, rng.choice(("Keywords: ", "KEY WORDS:", "")) + rng.choice((", ", "; ", ",")).join(words) + rng.choice(("", ".")), words, rng.randint(1, 30)))
    df = spark.createDataFrame([(r[0], r[1], r[3], T.roman(r[5])) for r in rows], "id int, doi string, line string, sign string")
    got = {r["id"]: r for r in df.select("id", T.doi(F.col("doi")).alias("doi"), T.keyword_list(F.col("line")).alias("words"), T.roman_value(F.col("sign")).alias("n")).collect()}
    for i, _, doi, _, words, n in rows:
        assert (got[i]["doi"], got[i]["words"], got[i]["n"]) == (doi, words, n)
    assert [T.roman(n) for n in (4, 9, 14, 29, 30)] == ["IV", "IX", "XIV", "XXIX", "XXX"]


def test_fuzzy_pairs(spark):
    """One to one, best first, per page: each page has one title, which gets its best heading if that is near enough."""
    got = {r["block"]: r for r in catalog.queries()["fuzzy_pairs"](spark, SF).collect()}
    form = lambda x: re.sub(r"\W+", " ", x.lower()).strip()
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page["html"])
        heads = [html.unescape(re.sub("<[^>]*>", "", h)) for h in re.findall(r"(?is)<h[12][^>]*>(.*?)</h[12]>", page["html"])]
        ratios = [difflib.SequenceMatcher(None, form(title[1] if title else ""), form(h)).ratio() for h in heads]
        best = max(ratios, default=0)
        assert (page["page_id"] in got) == (best >= 0.45)
        if page["page_id"] in got:
            assert got[page["page_id"]]["ratio"] == pytest.approx(best)
            assert form(got[page["page_id"]]["b"]) in [form(h) for h, r in zip(heads, ratios, strict=True) if r == best]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_agglomerative(spark, k):
    rng = np.random.default_rng(k)
    points = rng.normal(size=(24, 4)) + 3 * rng.integers(0, 2, (24, 4))
    df = spark.createDataFrame([*((i, p.tolist()) for i, p in enumerate(points)), (99, None)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster_id"] for r in clustering.agglomerative(df, k).collect()}
    assert got.pop(99) is None
    groups = [[i] for i in range(len(points))]
    spread = lambda g: ((points[g] - points[g].mean(axis=0)) ** 2).sum()
    while len(groups) > k:
        _, a, b = min((spread(x + y) - spread(x) - spread(y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    assert sorted(sorted(i for i in got if got[i] == c) for c in set(got.values())) == sorted(map(sorted, groups))


def test_all_pairs_are_for_chapters(spark):
    rows = spark.range(clustering.MOST_CHAPTERS + 1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    for compare in (clustering.agglomerative, clustering.density):
        with pytest.raises(ValueError, match="pairs"):
            compare(rows)


def test_silhouette(spark):
    """Against its definition, on unit vectors by squared distance."""
    rng = np.random.default_rng(4)
    points, own = rng.normal(size=(30, 3)), [0, 1, 2] * 10
    df = spark.createDataFrame([(p.tolist(), c) for p, c in zip(points, own, strict=True)], "embedding array<double>, cluster_id int")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    far = ((unit[:, None] - unit[None]) ** 2).sum(axis=2)
    scores = []
    for i, c in enumerate(own):
        mean = {d: far[i, [j for j in range(30) if own[j] == d and j != i]].mean() for d in (0, 1, 2)}
        other = min(v for d, v in mean.items() if d != c)
        scores.append((other - mean[c]) / max(other, mean[c]))
    assert clustering.silhouette(df) == pytest.approx(float(np.mean(scores)), abs=1e-6)
    assert math.isfinite(scores[0])
