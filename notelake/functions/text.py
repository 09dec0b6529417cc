"""Native column expressions for text, tags and durations. No Python UDFs."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MIN_KEYWORD_CHARS, PREVIEW_CHARS

# Every character that counts as white space at the edges of a text.
_EDGE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_KEYWORD_BREAK = r"(?U)[\s\x1c-\x1f\-_,]+"
# Form of a duration, and days per unit.
_DURATION = re.compile(r"([0-9]+)([dwm])")
_UNIT_DAYS = {"d": 1, "w": 7, "m": 30}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_EDGE_SPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def normalized(text: Column) -> Column:
    """Form under which two texts count as the same note."""
    return F.lower(strip(text))


def text_key(text: Column) -> Column:
    """Short stand-in for ``normalized`` so that shuffles carry 64 characters, not whole texts."""
    return digest(normalized(text))


def digest(text: Column) -> Column:
    # Never NULL, so that joins on it do not first compute it a second time to drop NULLs.
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def parse_tags(raw: Column) -> Column:
    """JSON list of strings; anything else becomes an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def haystack(text: Column, tags: Column) -> Column:
    no_tags = F.array().cast("array<string>")
    return F.lower(F.concat(text, F.lit(" "), F.array_join(F.coalesce(tags, no_tags), " ")))


def keywords(query: Column) -> Column:
    """Lower-case words of at least three characters, repeats kept."""
    return F.filter(
        F.split(F.lower(query), _KEYWORD_BREAK), lambda word: F.length(word) >= MIN_KEYWORD_CHARS
    )


def split_words(query: str) -> list[str]:
    """``keywords`` of one given query."""
    return [w for w in re.split(r"[\s\-_,]+", query.lower()) if len(w) >= MIN_KEYWORD_CHARS]


def query_words(query: str) -> Column:
    """``keywords`` of one given query as a literal list, so that it is not split again per row."""
    return F.array(*[F.lit(w) for w in split_words(query)]).cast("array<string>")


def keyword_hits(words: Column, hay: Column) -> Column:
    """Number of keywords found, repeats counted. ``hay`` is bound once, not built per keyword."""
    found = F.transform(F.array(hay), lambda h: F.size(F.filter(words, lambda word: F.contains(h, word))))
    return F.element_at(found, 1)


def keywords_needed(words: Column) -> Column:
    """Half of the keywords rounded up, at least one."""
    return F.greatest(F.ceil(F.size(words) / F.lit(2)).cast("int"), F.lit(1))


def keyword_match(words: Column, hay: Column) -> Column:
    return (F.size(words) > 0) & (keyword_hits(words, hay) >= keywords_needed(words))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def duration_cutoff(duration: str | None, as_of: date | str) -> str | None:
    """First ISO date inside the window, or None when the duration does not parse."""
    found = _DURATION.fullmatch((duration or "").strip().lower())
    if not found:
        return None
    anchor = date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return (anchor - timedelta(days=int(found[1]) * _UNIT_DAYS[found[2]])).isoformat()
