"""Fixed table layout and the numeric limits every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("tags", T.ArrayType(T.StringType()), True),
        T.StructField("created_at", T.StringType(), False),
    ]
)

GROUP_KEYS = ("role", "category")
RECORD_COLUMNS = ("id", "role", "category", "text", "tags", "created_at")

# Thresholds and limits of the memory table and its note files.
DEDUP_THRESHOLD = 0.92
SEARCH_THRESHOLD = 0.75
TIMELINE_LIMIT = 100
MAX_LINES = 80
MAX_SESSION_ENTRIES = 15
MIN_SESSION_ENTRIES = 5
PREVIEW_CHARS = 80
MIN_KEYWORD_CHARS = 3
SESSION_HEADER = "## Session Log"
SECTION_HEADER = "## "
ENTRY_PREFIX = "- ["
