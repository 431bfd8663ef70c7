"""Text functions as column expressions, and their driver-side twins for queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space class of ECMAScript's \s, for Java's and Python's regular expressions.
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_SPACES = re.compile(SPACE_CLASS + "+")
#: The snippet's window and the characters shown before its anchor; limits of a page.
SNIPPET_CHARS, SNIPPET_LEAD = 220, 60
DEFAULT_LIMIT, MOST_LIMIT = 10, 50
#: Fixed value: the form of a chunk id.
CHUNK_ID = r"^(?!\s)([^#\s]+)(#[^#\s]+)?$"


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE_CLASS + "+", " "))


def normalize(text: str) -> str:
    return _SPACES.sub(" ", text.lower()).strip(" ")


def tokenized(text: Column) -> Column:
    """Runs of a-z and 0-9 of a normalised text."""
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def tokenize(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text)


def query_terms(query: str) -> list[str]:
    return tokenize(normalize(query))


def slugified(text: Column) -> Column:
    """Heading slug; 'section' if nothing is left."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9 -]", "")
    s = F.regexp_replace(F.regexp_replace(s, " +", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def slugify(text: str) -> str:
    s = re.sub("-+", "-", re.sub(" +", "-", re.sub("[^a-z0-9 -]", "", text.lower())))
    return re.sub("^-|-$", "", s) or "section"


def short_slug(text: str, most: int = 50) -> str:
    """Slug of a scenario's name."""
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", text.lower()))[:most]


def suite_name(text: str, most: int = 80) -> str:
    """File-system name of a suite."""
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9_-]+", "-", text.lower()))[:most] or "default"


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def snippet(text: Column, query: str) -> Column:
    """A window of the normalised text around the first query term, in query order, that occurs."""
    flat = normalized(text)
    anchor = F.lit(0)
    for term in reversed(query_terms(query)):
        place = F.instr(flat, term)
        anchor = F.when(place > 0, place - 1).otherwise(anchor)
    start = F.greatest(F.lit(0), anchor - SNIPPET_LEAD)
    end = F.least(F.length(flat), start + SNIPPET_CHARS)
    window = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(flat, start + 1, end - start)), F.when(end < F.length(flat), "...").otherwise(""))
    return F.when(F.length(flat) <= SNIPPET_CHARS, flat).otherwise(window)


def is_chunk_id(value: Column) -> Column:
    return value.rlike(CHUNK_ID)


def clamp_limit(limit: object) -> int:
    return max(1, min(MOST_LIMIT, limit)) if isinstance(limit, int) and not isinstance(limit, bool) else DEFAULT_LIMIT


def posix_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def without_fences(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"(?s)```.*?```", "")


def heading_count(markdown: Column, level: int) -> Column:
    return F.regexp_count(markdown, F.lit(rf"(?m)^#{{{level}}}[ \t]+\S"))


def embedding_input(breadcrumb: Column, content: Column) -> Column:
    """What is embedded of a chunk (fixed format)."""
    return F.concat(F.lit("Context: "), breadcrumb, F.lit("\n\nContent:\n"), content)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def joined_hash(*parts: Column) -> Column:
    """sha256 of the parts with NUL between them."""
    return sha256(F.concat_ws("\0", *parts))


def rounded(value: Column) -> Column:
    return F.round(value, 6)
