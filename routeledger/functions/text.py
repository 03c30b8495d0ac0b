"""Text helpers with Python's notion of white space, lines and word characters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes, the line boundaries of
# str.splitlines(), and the regex class equal to Python's Unicode \w (the ASCII
# ranges are redundant; they are tested first and spare most property lookups).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[A-Za-z0-9_\p{L}\p{N}]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# \b for the WORD class; Java's own \b follows a different class.
WORD_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def _without_last_if_empty(parts: Column) -> Column:
    return bind(
        parts,
        lambda p: F.when(
            F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)
        ).otherwise(p),
    )


def physical_lines(content: Column) -> Column:
    """Lines as str.splitlines() would give them."""
    return _without_last_if_empty(F.split(content, LINE_BREAK))


def newline_lines(content: Column) -> Column:
    """Lines as reading a text file line by line gives them, without the newline."""
    return _without_last_if_empty(F.split(content, r"\r\n|\n|\r"))


def contains_any(text: Column, words: list[str] | Column) -> Column:
    """True if any word is a substring of ``text``, ignoring case; null text is False."""
    if isinstance(words, Column):
        low = F.lower(text)
        hit = F.exists(words, lambda w: F.contains(low, F.lower(w)))
    elif words:
        # One alternation keeps the plan small.
        hit = F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words))
    else:
        hit = F.lit(False)
    return F.coalesce(hit & (text != ""), F.lit(False))


def join_present(*parts: Column) -> Column:
    """Join the non-null parts with '; '; null if there are none."""
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]
