"""Functions that Spark lacks, over Arrow batches of the standard library's implementations."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import types as ST
from pyspark.sql.functions import arrow_udf, pandas_udf

_HEADER = ST.StructType([ST.StructField("title", ST.StringType()), ST.StructField("authors", ST.StringType())])


#: Values of an Arrow column that are Python objects at a time.
PIECE = 256


def mapped(column: pa.Array, fn: Callable, kind: pa.DataType) -> pa.Array:
    """A function of each value of an Arrow column. A worker holds the column and its result in Arrow, and few values as Python objects."""
    return pa.concat_arrays([pa.array([fn(x) for x in column.slice(at, PIECE).to_pylist()], kind) for at in range(0, max(len(column), 1), PIECE)])


@pandas_udf(ST.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's similarity of two strings; null if one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Abbreviations behind which a sentence goes on.
ABBREVIATIONS = frozenset("dr mr mrs ms prof st vs etc cf ed eds vol no pp p fig e.g i.e al jr sr inc".split())
_BREAK = re.compile(r"([.!?]+[\"')\]]*)\s+(?=[\"'(\[]*[A-Z0-9À-Þ])")


def split_sentences(text: str | None) -> list[str]:
    """Sentences by final marks before a capital or digit, unless an abbreviation or initial stands before."""
    if not text or not text.strip():
        return []
    out, begin = [], 0
    for m in _BREAK.finditer(text):
        before = text[begin : m.start()].rsplit(None, 1)
        last = before[-1].lower().strip("\"'([") if before else ""
        if m[1].startswith(".") and (last in ABBREVIATIONS or (len(last) == 1 and last.isalpha())):
            continue
        out.append(text[begin : m.end(1)].strip())
        begin = m.end()
    return [*out, rest] if (rest := text[begin:].strip()) else out


@arrow_udf(ST.ArrayType(ST.StringType()))
def sentences(text: pa.Array) -> pa.Array:
    return mapped(text, split_sentences, pa.list_(pa.string()))


#: Words that open lines before a title, and what authors' lines hold.
_PREAMBLE = re.compile(r"(?i)^(vol(ume)?\b|issue\b|issn|doi|http|published|received|accepted|©|copyright|springer|editorial\b|\d+\s*$)")
_AUTHOR = re.compile(r"^[A-ZÀ-Þ][\w.'\-]+(?:\s+[A-ZÀ-Þ][\w.'\-]*\.?){1,3}(?:\d*)(?:\s*(?:,|·|&|\band\b)\s*[A-ZÀ-Þ][\w.'\-]+(?:\s+[A-ZÀ-Þ][\w.'\-]*\.?){1,3}\d*)*$")


def parse_header(text: str | None) -> dict[str, str | None]:
    """FN-34: title and authors of a text's first lines: the first line like names, and the lines right above it."""
    lines = [x.strip() for x in (text or "").split("\n")[:40]]
    at = next((i for i, x in enumerate(lines) if i and _AUTHOR.match(x) and any(lines[:i])), None)
    if at is None:
        return {"title": None, "authors": None}
    title: list[str] = []
    for line in reversed(lines[:at]):
        if not line or _PREAMBLE.match(line):
            if title:
                break
            continue
        title.insert(0, line)
    authors = re.sub(r",\s*,", ",", re.sub(r"\s*[·&]\s*", ", ", re.sub(r"(?<=[^\W\d_])\d+", "", lines[at])))
    return {"title": " ".join(title) or None, "authors": authors}


@pandas_udf(_HEADER)
def header(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_header(x) for x in text], columns=["title", "authors"])


@pandas_udf(_HEADER)
def header_blocks(blocks: pd.Series) -> pd.DataFrame:
    """FN-35: title and authors where the first two blocks of a page are just these."""
    found = [list(x) if x is not None else [] for x in blocks]
    return pd.DataFrame({"title": [" ".join(x[0].split()) if x else None for x in found], "authors": [" ".join(x[1].split()) if len(x) > 1 else None for x in found]})
