"""Narrative cleaning of book chunks (TXT-01..10, WIN-09, WIN-10, UDF-05), as column expressions in their fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that define what is cleaned away.
RUNNING_HEADER = r"\n[A-Z][^\n]{3,79}\n[ \t]+\n[ \t]*\d{1,4}[ \t]*\n"
REFERENCES = r"(?is)\n[ \t]*(?:References|Bibliography|Works\s+Cited|Reference List)[ \t]*\n.*"
LOG_LABEL = r"(?i)\nLog\s+\d+[-.\d]*\.\s*\n"
THREE_LINE_TURN = r"(\n\d{1,3}[ \t]+)\n([A-Za-z][a-zA-Z0-9_]{0,20}[ \t]*:[ \t]*)\n([^\n]*)"
TWO_LINE_TURN = r"(\n\d{1,3}[ \t]*)\n([A-Za-z][a-zA-Z0-9_]{0,20}[ \t]*:[^\n]+)"
TURN_LINE = r"^\d{1,3}\.?[ \t]+(?:[A-Za-z][a-zA-Z0-9_]{0,20}[ \t]*[:(]|\d{1,2}:\d{2})"
PROSE_LINE = r"^[A-Z].{30,}"
NAME_LINE = r"^[A-Za-z][a-zA-Z0-9_]{0,20}[: \t]"
CAPTION = r"(?mi)^[ \t]*(?:Fig(?:ure)?\.?|Table)[ \t]+[\d\-]+[.\s][^\n]*\n?"
PAGE_NUMBER = r"(?m)^\s*\d{1,4}\s*$"
FOOTNOTE_MARK = r"(?i)p\.\s*\d|pp\.\s*\d|\(\d{4}\)|Ibid\.|Cf\.\s|\bPress\b|\bUniversity\b|\bJournal\b|\bTrans\.?\b"
FOOTNOTE_START = r"(?s)^\d{1,2}[ \t]+[A-Z\"'«\d].*"
LEAST_RUN = 3


def strip_running_headers(text: Column) -> Column:
    """TXT-01."""
    return F.regexp_replace(text, RUNNING_HEADER, "\n")


def strip_references(text: Column) -> Column:
    """TXT-02."""
    return F.regexp_replace(text, REFERENCES, "")


def join_turns(text: Column) -> Column:
    """TXT-03: chat turns over three or two lines on one."""
    return F.regexp_replace(F.regexp_replace(text, THREE_LINE_TURN, "$1$2$3"), TWO_LINE_TURN, "$1$2")


def from_prose(block: Column) -> Column:
    """WIN-10: the lines from the first of prose on; nothing if there is none.

    A line whose first word is followed by a blank counts as a turn's, as the name pattern has it.
    """
    lines = F.split(block, "\n")
    prose = F.transform(lines, lambda x: F.trim(x).rlike(PROSE_LINE) & ~F.trim(x).rlike(NAME_LINE) & (F.length(F.trim(x)) > 30))
    at = F.array_position(prose, F.lit(True)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)), "\n")).otherwise("")


def strip_logs(text: Column) -> Column:
    """TXT-04: behind each log label, all up to the next prose."""
    parts = F.split(text, LOG_LABEL)
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(from_prose(p))), "\n")).otherwise(text)


def strip_turn_runs(text: Column) -> Column:
    """TXT-05, WIN-09: three turn lines or more in a row go.

    Every line is given the break before it, so a run is one match; it is possessive, so a run of any length
    is matched in a loop, without stack and without going back.
    """
    run = rf"(?:\n{TURN_LINE.removeprefix('^')}[^\n]*+){{{LEAST_RUN},}}+"
    return F.substr(F.regexp_replace(F.concat(F.lit("\n"), text), run, ""), F.lit(2))


def strip_captions(text: Column) -> Column:
    """TXT-06."""
    return F.regexp_replace(text, CAPTION, "\n")


def strip_page_numbers(text: Column) -> Column:
    """TXT-07."""
    return F.regexp_replace(text, PAGE_NUMBER, "")


def strip_footnotes(text: Column) -> Column:
    """TXT-08: blocks between blank lines that begin with a small number and hold two reference marks or more."""
    blocks = F.split(text, r"\n[ \t]*\n")
    note = lambda b, i: (i > 0) & b.rlike(FOOTNOTE_START) & (F.regexp_count(b, F.lit(FOOTNOTE_MARK)) >= 2)
    return F.array_join(F.transform(blocks, lambda b, i: F.when(note(b, i), F.lit("")).otherwise(b)), "\n\n")


def normalise_space(text: Column) -> Column:
    """TXT-09."""
    one = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(one, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """TXT-10: all steps, in order."""
    for step in (strip_running_headers, strip_references, join_turns, strip_logs, strip_turn_runs, strip_captions, strip_page_numbers, strip_footnotes, normalise_space):
        text = step(text)
    return text
