"""Reports: parsers of text reports (TXT-20..26, SRC-15, SRC-16) and renderers (SNK-02, SNK-09, SNK-10, SNK-12, SNK-13)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.functions import arrow_udf

from corpuslab.functions import text as T
from corpuslab.functions.fuzzy import mapped

#: Lines that separate sections, in the report's and the summary parser's sense.
SEPARATOR = r"^\s*(?:-{3,}|━{5,}|═{5,}|={5,}|─{5,})\s*$"
SUMMARY_SEPARATOR = r"^\s*[=─━—═\-_~]{4,}\s*$"
FRAGMENT = r"^\s*(?:-{1,6}|━{1,6}|═{1,6}|={1,6}|─{1,6})\s*$"
CHAPTER_HEADING = r"(?i)^(?:chapter\s+(\d+)\s*[.:]|chapter\s+([IVXLC]+)\s*[.:]|(\d+)\.\s+\S)"
OVERVIEW_HEADING = r"(?i)^(?:overview(?:\s+of\s+the\s+collection)?|overview(?:\s*:\s*\S)?|.+—\s*(?:summary\s+of|collection\s+overview))"
BOOK_OVERVIEW = r"(?i)^(?:book\s+overview|overview(?:\s+of\s+the\s+collection)?(?::\s*.+)?|.+\bcollection\s+overview\b)$"
OVERVIEW_SEPARATOR = r"^[═=━—‒\-]{5,}$"
SECTION_HEADING = r"(?im)^((?:chapter|investigation)\s+\d+[.:][^\n]{0,250}|book\s+overview|overview)$"
STRUCTURAL = r"(?i)^(?:part\s+\w+|chapter\s+summaries|book\s+\d+:|overview|book\s+overview)"
SHORT_BODY = 30


def is_separator(line: Column) -> Column:
    """TXT-20."""
    return line.rlike(SEPARATOR)


def is_summary_separator(line: Column) -> Column:
    return line.rlike(SUMMARY_SEPARATOR)


def lines_of(reports: DataFrame, key: str, text: str) -> DataFrame:
    return reports.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def chapter_texts(reports: DataFrame, key: str, text: str) -> DataFrame:
    """TXT-22: (key, chapter, text): bodies under chapter headings, and with chapter 0 the overview; parts of one number joined."""
    w = Window.partitionBy(key).orderBy("line_no")
    number = F.coalesce(F.regexp_extract("line", CHAPTER_HEADING, 1).try_cast("int"), T.roman_value(F.regexp_extract("line", CHAPTER_HEADING, 2)), F.regexp_extract("line", CHAPTER_HEADING, 3).try_cast("int"))
    before = F.coalesce(F.lag("line").over(w), F.lit(""))
    overview = F.col("line").rlike(OVERVIEW_HEADING) & ((F.trim(before) == "") | before.rlike(SUMMARY_SEPARATOR))
    marked = lines_of(reports, key, text).withColumn("opens", F.coalesce(number, F.when(overview, F.lit(0))))
    carried = marked.withColumn("part", F.count("opens").over(w)).withColumn("chapter", F.last("opens", True).over(w))
    skipped = F.col("line").rlike(SUMMARY_SEPARATOR) | F.startswith("line", F.lit("Keywords:")) | F.startswith("line", F.lit("---"))
    body = carried.filter(F.col("chapter").isNotNull() & F.col("opens").isNull() & ~skipped)
    parts = body.groupBy(key, "chapter", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    trimmed = parts.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))
    ordered = F.array_sort(F.collect_list(F.struct("part", "body")))
    return trimmed.groupBy(key, "chapter").agg(F.array_join(F.transform(ordered, lambda x: x["body"]), "\n\n").alias("text"))


def overview_after_separator(report: str | None) -> str:
    """TXT-23: what follows an overview heading with a separator within three lines of it."""
    lines = (report or "").splitlines()
    rules = [bool(re.match(OVERVIEW_SEPARATOR, x.strip())) for x in lines]
    for i, line in enumerate(lines):
        if re.match(BOOK_OVERVIEW, line.strip()) and (any(rules[max(0, i - 3) : i]) or any(rules[i + 1 : i + 4])):
            start = i + 1
            while start < len(lines) and (rules[start] or not lines[start].strip()):
                start += 1
            return "\n".join(lines[start:]).strip()
    return ""


@arrow_udf(ST.StringType())
def overview(report: pa.Array) -> pa.Array:
    """TXT-23 for a column of reports."""
    return mapped(report, overview_after_separator, pa.string())


def keywords_in(block: str) -> list[str]:
    """The list behind "Keywords:", over following lines until one is blank or the list has ended."""
    found, open_ = "", False
    for line in block.splitlines():
        if m := re.match(r"(?i)keywords?:\s*(.*)", line):
            found, open_ = m[1], True
        elif open_ and line.strip() and not found.rstrip().endswith("."):
            found += " " + line.strip()
        else:
            open_ = False
    return [k.strip() for k in found.split(",") if k.strip()]


def without_keywords(block: str) -> str:
    kept, skip = [], False
    for line in block.splitlines():
        if re.match(r"(?i)keywords?:", line):
            skip = True
        elif skip and not line.strip():
            skip = False
        if not skip and not re.match(FRAGMENT, line):
            kept.append(line)
    return "\n".join(kept).strip()


def report_sections(report: str | None) -> list[tuple[str, str, list[str]]]:
    """TXT-21: (title, body, keywords) of a report's blocks.

    A block's first line is its title. A block without a real body hands its title to the next one that has a
    body, unless it is a structural heading; a block with several chapter headings is cut at these.
    """
    blocks = [b.strip() for b in re.split(SEPARATOR.replace("^", "(?m)^", 1), report or "") if b.strip()]
    parsed = []
    for block in blocks:
        rows = block.splitlines()
        at = next((i for i, x in enumerate(rows) if x.strip() and not re.match(FRAGMENT, x)), None)
        parsed.append((rows[at].strip(), "\n".join(rows[at + 1 :]).strip(), block) if at is not None else ("", block, block))
    out: list[tuple[str, str, list[str], str]] = []
    waiting, pending = False, ""
    for title, body, full in parsed:
        if len(body) < SHORT_BODY:
            pending = pending if re.match(STRUCTURAL, title) else title
            waiting = True
            continue
        if waiting:
            out.append((pending or title, without_keywords(full), keywords_in(full), full))
        else:
            out.append((title, without_keywords(body), keywords_in(full), full))
        waiting, pending = False, ""
    sections = []
    for title, body, keys, full in out:
        marks = list(re.finditer(SECTION_HEADING, full))
        if len(marks) < 2:
            sections.append((title, body, keys))
            continue
        for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(full)], strict=True):
            part = full[m.end() : end].strip()
            sections.append((m[1].strip(), without_keywords(part), keywords_in(part)))
    return sections


def parse_sections(reports: DataFrame, key: str, text: str) -> DataFrame:
    """TXT-21: (key, pos, title, body, keywords): a parser for each document, in Arrow batches."""
    rows = reports.select(key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, i, *s) for k, t in frame.itertuples(index=False, name=None) for i, s in enumerate(report_sections(t))]
            yield pd.DataFrame(found, columns=[key, "pos", "title", "body", "keywords"])

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, pos int, title string, body string, keywords array<string>")


def numbered_chapters(report: str | None) -> list[dict]:
    """TXT-25: "N. Title", wrapped over lines up to a rule, then paragraphs; only between the first two double rules."""
    text = report or ""
    stops = list(re.finditer(r"(?m)^={5,}", text))
    if stops:
        text = text[stops[0].end() : stops[1].start() if len(stops) > 1 else len(text)]
    pieces = re.split(r"(?m)^(\d+\.\s+\S[^\n]*(?:\n(?![-─]{5,}$)[^\n]*)*?)\n[-─]{5,}[ \t]*$", text)
    out = []
    for title, body in zip(pieces[1::2], pieces[2::2], strict=True):
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", body) if p.strip()]
        out.append({"title": " ".join(title.split(".", 1)[1].split()), "paragraphs": paragraphs})
    return out


def parse_numbered(reports: DataFrame, key: str, text: str) -> DataFrame:
    """TXT-25: (key, pos, title, paragraphs) of every report, in Arrow batches."""
    rows = reports.select(key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, i, c["title"], c["paragraphs"]) for k, t in frame.itertuples(index=False, name=None) for i, c in enumerate(numbered_chapters(t))]
            yield pd.DataFrame(found, columns=[key, "pos", "title", "paragraphs"])

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, pos int, title string, paragraphs array<string>")


def prompts(files: DataFrame, text: str) -> DataFrame:
    """TXT-26: (stem, prompt): each paragraph under its first word."""
    paragraphs = files.select(F.explode(F.split(text, r"\n\n")).alias("p")).select(F.trim("p").alias("prompt")).filter("prompt <> ''")
    return paragraphs.select(F.regexp_replace(F.split("prompt", r"\s+")[0], r"[,.]+$", "").alias("stem"), "prompt")


def insert_before(html: Column, marker: str, block: Column) -> Column:
    """TXT-24: a block put before the first marker; null where there is none."""
    at = F.locate(marker, html)
    return F.when(at > 0, F.concat(F.substr(html, F.lit(1), at - 1), block, F.substr(html, at)))


def replace_between(html: Column, start: str, end: str, block: Column) -> Column:
    """TXT-24: what stands between two markers replaced; unchanged where they are not there."""
    a = F.locate(start, html)
    b = F.locate(end, html, 1)
    return F.when((a > 0) & (b > a), F.concat(F.substr(html, F.lit(1), a + len(start) - 1), block, F.substr(html, b))).otherwise(html)


def move_section(html: Column, start: str, end: str, before: str) -> Column:
    """TXT-24: the section from start up to end, moved before another marker."""
    a, b = F.locate(start, html), F.locate(end, html)
    section = F.substr(html, a, b - a)
    rest = F.concat(F.substr(html, F.lit(1), a - 1), F.substr(html, b))
    return F.when((a > 0) & (b > a), F.coalesce(insert_before(rest, before, section), html)).otherwise(html)


def space_paragraphs(html: Column, start: str = "<h1>Overview</h1>", end: str = "<hr>") -> Column:
    """TXT-24: a spacer between the paragraphs of a section that have none."""
    a = F.locate(start, html)
    body = F.substr(html, a)
    stop = F.locate(end, body, 2)
    length = F.when(stop > 0, stop - 1).otherwise(F.length(body))
    spaced = F.regexp_replace(F.substr(body, F.lit(1), length), r"(?<!<p>)(</p>)\n(<p class=\"indent\">)", "$1\n<p></p>\n$2")
    return F.when(a > 0, F.concat(F.substr(html, F.lit(1), a - 1), spaced, F.substr(body, length + 1))).otherwise(html)


def scraped_numbers(text: Column, label: str) -> Column:
    """SRC-16: the number behind a label in a report, thousands separators removed."""
    return F.regexp_replace(F.regexp_extract(text, label + r"\D*?([\d,]+)", 1), ",", "").try_cast("long")


def truncated(df: DataFrame, n: int = 10, names: tuple[str, ...] = ("_text", "text", "_prompt")) -> DataFrame:
    """SNK-02, FN-28: every text field at any depth cut to its first words, line and paragraph separators escaped."""

    def cut(c: Column, kind: ST.DataType, name: str) -> Column:
        if isinstance(kind, ST.StringType):
            if any(name == x or (x.startswith("_") and name.endswith(x)) for x in names):
                c = T.first_words(c, n)
            return F.replace(F.replace(c, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))
        if isinstance(kind, ST.StructType):
            return F.when(c.isNotNull(), F.struct(*(cut(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
        if isinstance(kind, ST.ArrayType) and isinstance(kind.elementType, ST.StringType | ST.StructType | ST.ArrayType):
            return F.transform(c, lambda x: cut(x, kind.elementType, name))
        return c

    return df.select(*(cut(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields))


def fixed_width(df: DataFrame, widths: dict[str, int], order: str) -> DataFrame:
    """SNK-09: one line a row, columns padded and cut."""
    return df.orderBy(order).select(F.rtrim(F.concat_ws(" ", *(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ") for c, n in widths.items()))).alias("line"))


def side_by_side(df: DataFrame, left: str, right: str, width: int) -> Column:
    return F.concat(F.rpad(F.coalesce(left, F.lit("")), width, " "), F.lit(" | "), F.coalesce(right, F.lit("")))


def html_page(sections: DataFrame, key: str, order: str, title: str, body: str) -> DataFrame:
    """SNK-10: (key, html): a page of each document's sections in order."""
    part = F.concat(F.lit("<h1>"), T.escape_html(F.col(title)), F.lit("</h1>\n"), T.html_paragraphs(F.coalesce(body, F.lit(""))))
    parts = F.array_sort(F.collect_list(F.struct(order, part.alias("h"))))
    joined = F.array_join(F.transform(parts, lambda p: p["h"]), "\n<hr>\n")
    return sections.groupBy(key).agg(F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n'), joined, F.lit("\n</body></html>")).alias("html"))


def status_page(generated: str, previous: str | None, marker: str = "## Notes") -> str:
    """SNK-12: the generated page with the hand-written part of the previous one."""
    kept = previous[previous.index(marker) :] if previous and marker in previous else marker + "\n"
    return f"{generated.rstrip()}\n\n{kept}"


def graph_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """SNK-13: (value): entities and relations as JSON lines."""
    e = entities.select(F.to_json(F.struct(F.lit("entity").alias("type"), "name", "entityType", "observations")).alias("value"))
    return e.unionByName(relations.select(F.to_json(F.struct(F.lit("relation").alias("type"), "from", "to", "relationType")).alias("value")))
