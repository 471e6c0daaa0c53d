"""Scalar text functions as Spark column expressions.

Each takes a column and gives a column, so that everything stays in the JVM. White space is Unicode's where
the pattern says ``(?U)``; patterns that queries also state in SQL keep to ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heading titles that are left out, as wholes or as beginnings.
EXCLUDED_EXACT = ("introduction", "preface", "abstract", "notice", "vita")
EXCLUDED_PREFIX = (
    "contents", "notes", "references", "bibliography", "tables", "logs", "figures", "acknowledgements", "acknowledgment", "authors and collaborators",
    "notes ….", "notes & comments", "notes on the investigations", "note", "index of names", "index of terms", "author index", "author's biography", "authors biography",
)
#: The legacy rule also takes these as beginnings.
LEGACY_PREFIX = (*EXCLUDED_EXACT, *EXCLUDED_PREFIX)
#: Words in what follows a title that tell a monograph.
MONOGRAPH_PUBLISHERS = ("mit press", "springer", "cambridge", "oxford", "routledge", "erlbaum", "wiley", "elsevier", "kluwer", "lulu")
#: What stands for a structural title.
STRUCTURAL_TITLE = r"(?i)^\s*(part\s+[ivxlcdm\d]+|contents|references|bibliography|index|notes|acknowledg\w*)\b"


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded half to even."""
    return F.bround(word_count(text) * F.lit(1.3)).cast("long")


def approx_page(offset: Column, length: Column, pages: Column) -> Column:
    """1 + floor(offset / length * pages); 0 if there is no length or no page."""
    return F.when((length == 0) | (pages == 0), F.lit(0)).otherwise(1 + F.floor(offset / length * pages)).cast("long")


def year_of(reference: Column, suffix: bool = True) -> Column:
    """The first year in parentheses, with or without a letter behind it; null if there is none."""
    found = F.regexp_extract(reference, r"\((\d{4}[a-z]?)\)" if suffix else r"\((\d{4})\)", 1)
    return F.substring(found, 1, 4).try_cast("int")


def year_with_source(chapter_reference: Column, book_reference: Column) -> tuple[Column, Column]:
    """The chapter's year, else the book's, else null; and where it is from."""
    own, book = year_of(chapter_reference), year_of(book_reference)
    return F.coalesce(own, book), F.when(own.isNotNull(), "chapter").when(book.isNotNull(), "book").otherwise(F.lit(None).cast("string"))


def no_apostrophes(text: Column) -> Column:
    return F.regexp_replace(text, "['’‘]", "")


def normalise_title(title: Column) -> Column:
    """FN-06: the form in which titles are matched: labels, numbers and authors gone, lower case, single blanks.

    A leading word made of Roman digits alone goes, too, whatever it means.
    """
    steps = (
        r"(?i)^(?:chapter|part|section)\s+(?:[ivxlcdm]+|\d+)[\.:\s–\-]+",
        r"^\d+[\.:\s]+",
        r"(?i)^[ivxlcdm]+[\.:\s]+",
        r"(?i)^introduction\s+to\s+part\s+(?:[ivxlcdm]+|\d+)[\s\.:–\-]+",
        r"\s+by\s+[A-ZÀ-ɏ].+$",
    )
    bare = reduce(lambda t, step: F.trim(F.regexp_replace(t, step, "")), steps, F.trim(title))
    return F.trim(F.regexp_replace(no_apostrophes(F.lower(bare)), r"\s+", " "))


def is_excluded_title(title: Column, exact: tuple[str, ...] = EXCLUDED_EXACT, prefix: tuple[str, ...] = EXCLUDED_PREFIX) -> Column:
    """Front and back matter: a listed title, the plural or beginning of one, or a line of a table of contents."""
    plain = F.regexp_replace(F.lower(F.trim(title)), r"[\s.…]+$", "")
    forms = (plain, no_apostrophes(plain))

    def listed(form: Column) -> Column:
        begins = F.exists(F.lit(list(prefix)), lambda p: form.startswith(F.concat(p, F.lit(" "))))
        return form.isin(*exact, *prefix, *(p + "s" for p in prefix)) | begins

    hit = [listed(form) for form in forms]
    return hit[0] | hit[1] | F.coalesce(title.rlike(r"\.{3,}"), F.lit(False))


def is_legacy_excluded_title(title: Column) -> Column:
    """FLT-08."""
    return is_excluded_title(title, (), LEGACY_PREFIX)


def is_structural_title(title: Column) -> Column:
    return title.rlike(STRUCTURAL_TITLE)


def match_form(text: Column) -> Column:
    """Lower case, anything but word characters as single blanks: for citation titles and fuzzy matches."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def ascii_match_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-z_]+", " "))


def strip_number(heading: Column) -> Column:
    return F.regexp_replace(heading, r"^\d+\.\s*", "")


def safe_filename(text: Column, longest: int = 70) -> Column:
    """FN-10."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(text, r"[^\w\s-]", "")), r"\s+", "_"), 1, longest)


def doi(text: Column) -> Column:
    """FN-11: the first DOI, without punctuation behind it; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"'<>]+)", 1), r"[.,;]+$", ""), F.lit(""))


def strip_superscripts(text: Column) -> Column:
    """FN-12: digits right behind a letter."""
    return F.regexp_replace(text, r"(?<=[A-Za-zÀ-ɏ])\d+", "")


def join_authors(text: Column) -> Column:
    """FN-13: dots and ampersands between authors as commas, single commas only."""
    listed = F.regexp_replace(text, r"\s*[·&]\s*", ", ")
    return F.regexp_replace(listed, r",\s*,", ",")


def roman_value(text: Column, most: int = 30) -> Column:
    """FN-14: I to XXX as numbers, by a table made from the rule of Roman numerals."""
    table = F.create_map(*(F.lit(x) for n in range(1, most + 1) for x in (roman(n), n)))
    return F.try_element_at(table, F.upper(F.trim(text)))


def roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def parse_reference(entry: Column, year: Column) -> Column:
    """struct(title, type) of a reference-list entry: a chapter if ". In" follows, else by the words behind the title."""
    marker = F.concat(F.lit("("), year.cast("string"), F.lit(")."))
    at = F.instr(entry, marker)
    rest = F.ltrim(F.substr(entry, at + F.length(marker)))
    chapter = F.regexp_instr(rest, F.lit(r"\.\s+[Ii]n\b"))
    stop = F.regexp_instr(rest, F.lit(r"\.\s+"))
    tail = F.lower(F.substr(rest, stop + 1))
    publisher = reduce(lambda a, b: a | b, (F.contains(tail, F.lit(p)) for p in MONOGRAPH_PUBLISHERS))
    whole = F.regexp_replace(F.trim(rest), r"\.+$", "")
    title = F.when(at == 0, "").when(chapter > 0, F.regexp_replace(F.trim(F.substr(rest, F.lit(1), chapter - 1)), r"\.+$", "")).when(stop > 0, F.trim(F.substr(rest, F.lit(1), stop - 1))).otherwise(whole)
    kind = F.when(at == 0, "unknown").when(chapter > 0, "chapter").when((stop > 0) & publisher, "monograph").when(stop > 0, "article_or_other").otherwise("unknown")
    return F.struct(title.alias("title"), kind.alias("type"))


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def html_paragraphs(text: Column) -> Column:
    """Paragraphs between empty lines in p elements, *x* as emphasis; null for null."""
    # a lambda of its own: F.trim has a second parameter, which transform would give the paragraph's number as what to trim
    kept = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(kept, lambda p: F.concat(F.lit("<p>"), F.regexp_replace(escape_html(p), r"\*([^*]+)\*", "<em>$1</em>"), F.lit("</p>"))), "\n")


def keyword_list(line: Column) -> Column:
    """FN-17: a line of keywords, with or without a label, as a list."""
    bare = F.regexp_replace(line, r"(?i)^\s*key\s*words?\s*:\s*", "")
    return F.filter(F.transform(F.split(bare, "[,;]"), lambda x: F.regexp_replace(F.trim(x), r"\.$", "")), lambda x: x != "")


def first_words(text: Column, n: int = 10) -> Column:
    return F.concat_ws(" ", F.slice(words(text), 1, n))


def syllables(word: Column) -> Column:
    """Runs of vowels, without a silent e at the end; one at least."""
    low = F.lower(word)
    bare = F.when((F.length(low) > 2) & low.rlike("[^aeiouy]e$"), F.substr(low, F.lit(1), F.length(low) - 1)).otherwise(low)
    return F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]+")))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z'\-]{2,}\b"), F.lit(0))


def snippet(text: Column, position: Column, around: int = 80) -> Column:
    """Characters around a 1-based position, on one line."""
    begin = F.greatest(F.lit(1), position - around)
    return F.trim(F.translate(F.substr(text, begin, position + around - begin), "\n", " "))


def volume_of(year: Column, first: int = 2005) -> Column:
    return year - first


def file_size(n: Column) -> Column:
    """A number of bytes for people."""
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .otherwise(F.format_string("%.1f GB", n / 1024**3))
    )


def day_of(timestamp: Column) -> Column:
    """FN-31."""
    return F.substring(timestamp.cast("string"), 1, 10)


def passage_line(place: Column, book: Column, chapter: Column, text: Column) -> Column:
    return F.concat(F.lit("[Passage "), place.cast("string"), F.lit("] Book "), book.cast("string"), F.lit(", Ch "), chapter.cast("string"), F.lit(": "), text)


PASSAGE_SEPARATOR = "\n\n---\n\n"


def summary_words(level: Column, levels: Column) -> Column:
    """FN-33: target length of a summary: 100 or 200 words for two levels, else 50 to 200 in even steps."""
    return F.when(levels <= 2, F.when(level == 0, 100).otherwise(200)).otherwise(F.floor(50 + 150 * level / (levels - 1))).cast("int")


def fill_if_empty(value: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), default)


def excerpt(text: Column, n: int) -> Column:
    """The first n characters on one line."""
    return F.trim(F.translate(F.substring(text, 1, n), "\n", " "))
