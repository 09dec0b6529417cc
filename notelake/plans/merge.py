"""Idempotent import of JSON-lines records into the table, and vector back-fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.embed import embed_column
from ..operators.filters import pending_embeddings
from ..operators.ordering import first_wins
from ..operators.similarity import anti_join_existing
from ..schema import GROUP_KEYS


def merge_jsonl(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records to add: exact (role, category, text) not stored yet, first reading position wins.

    Importing the same tree again yields nothing. ``records`` as from ``read_jsonl_memories``.
    """
    keyed = records.withColumn("_t", X.digest(F.col("text")))
    fresh = first_wins(keyed, [*GROUP_KEYS, "_t"], ["path", "position"]).drop("_t")
    return anti_join_existing(fresh, stored)


def merge_summary(records: DataFrame, added: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """Per file: records read, migrated and skipped; plus a ``total`` line.

    The total counts every file, also those directly below the root that are passed over, and gives
    the table size after the import.
    """
    read = records.groupBy("path", *GROUP_KEYS).agg(F.count(F.lit(1)).alias("entries"))
    new = added.groupBy("path").agg(F.count(F.lit(1)).alias("m"))
    placed = files.where("role is not null")
    lines = placed.join(read, ["path", *GROUP_KEYS], "left").join(new, "path", "left").select(
        F.lit("file").alias("level"), *GROUP_KEYS, F.lit(1).cast("bigint").alias("files"),
        F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"),
        F.coalesce("m", F.lit(0)).cast("bigint").alias("migrated"),
        (F.coalesce("entries", F.lit(0)) - F.coalesce("m", F.lit(0))).cast("bigint").alias("skipped"),
        F.lit(None).cast("bigint").alias("table_rows"),
    )
    # Three one-row parts are added up rather than joined.
    counters = ("files", "entries", "migrated", "skipped", "table_rows")
    parts = [
        lines.select(F.lit(0).alias("files"), "entries", "migrated", "skipped", F.col("migrated").alias("table_rows")),
        files.select(F.lit(1).alias("files"), *[F.lit(0).alias(c) for c in counters[1:]]),
        stored.select(*[F.lit(0).alias(c) for c in counters[:-1]], F.lit(1).alias("table_rows")),
    ]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counters]
    )
    total = sums.select(
        F.lit("total").alias("level"), *[F.lit(None).cast("string").alias(k) for k in GROUP_KEYS], *counters
    )
    return lines.unionByName(total)


def rebuild_embeddings(entries: DataFrame, embed: Callable | None = None, **options) -> DataFrame:
    """The table with missing vectors filled in; only rows without one meet the embedder."""
    columns = entries.columns
    filled = embed_column(pending_embeddings(entries), embed, **options).select(*columns)
    return entries.where("embedding is not null").unionByName(filled)


def rebuild_report(entries: DataFrame) -> DataFrame:
    """Dry run: rows without a vector per (role, category), which are the directories to rewrite."""
    return pending_embeddings(entries).groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("pending"))
