"""Row filters of the memory table."""

from __future__ import annotations

from datetime import date
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import GROUP_KEYS
from .trigrams import rows_under_rare_grams

if TYPE_CHECKING:
    from ..sources.keyword_index import KeywordIndex

# Ids of candidates that are given to the scan itself.
PUSHED_IDS = 1000


def filter_role_category(df: DataFrame, role: str | None = None, category: str | None = None) -> DataFrame:
    """Equality on the two partition columns; an empty value means no filter."""
    if role:
        df = df.where(F.col("role") == role)
    if category:
        df = df.where(F.col("category") == category)
    return df


def filter_tag(df: DataFrame, tag: str | None) -> DataFrame:
    return df.where(F.array_contains("tags", tag)) if tag else df


def filter_since(df: DataFrame, duration: str | None, as_of: date | str) -> DataFrame:
    """``created_at`` within the duration; text comparison so that the scan can skip row groups."""
    cutoff = X.duration_cutoff(duration, as_of)
    return df.where(F.col("created_at") >= cutoff) if cutoff else df


def reject_reason() -> Column:
    """First missing field in the order role, category, text; NULL for a valid row."""
    # The three messages.
    reason = F.when(X.is_blank(F.col("role")), "role is required")
    reason = reason.when(X.is_blank(F.col("category")), "category is required")
    return reason.when(X.is_blank(F.col("text")), "text is required")


def validate_entries(df: DataFrame) -> DataFrame:
    """All rows with ``reject_reason``; callers split on whether it is NULL."""
    return df.withColumn("reject_reason", reject_reason())


def parse_tags(df: DataFrame, raw: str = "tags", out: str = "tags") -> DataFrame:
    return df.withColumn(out, X.parse_tags(F.col(raw)))


def tokenize_query(df: DataFrame, column: str = "query", out: str = "keywords") -> DataFrame:
    return df.withColumn(out, X.keywords(F.col(column)))


def may_hold(df: DataFrame, words: list[str], spare: int, index: KeywordIndex) -> DataFrame:
    """Rows that an index does not rule out: listed under a rare trigram of more of ``words`` than ``spare``, or later than the index."""
    if not words:
        return df
    found = rows_under_rare_grams(index.lists, words, spare)
    listed, later = (df.where(side) for side in (F.col("id") <= index.last_id, F.col("id") > index.last_id))
    # A short list of ids reaches the scan, which then leaves out row groups.
    some = found.select("id").distinct().limit(PUSHED_IDS + 1).collect()
    if len(some) <= PUSHED_IDS:
        listed = listed.where(F.col("id").isin([r["id"] for r in some]))
    return listed.join(found, [*GROUP_KEYS, "id"], "left_semi").unionByName(later)


def keyword_prefilter(df: DataFrame, query: str, *, index: KeywordIndex | None = None) -> DataFrame:
    """Rows holding any keyword; every row when the query has none. ``index``: a stored one of these rows."""
    words = X.query_words(query)
    if index is not None:
        asked = X.split_words(query)
        df = may_hold(df, asked, len(asked) - 1, index)
    return df.where((F.size(words) == 0) | (X.keyword_hits(words, X.haystack(F.col("text"), F.col("tags"))) > 0))


def pending_embeddings(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNull())
