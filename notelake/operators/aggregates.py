"""Counts, coverage and health of the table.

A stored table carries ``has_embedding``, so coverage never reads the vectors themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GROUP_KEYS
from .filters import filter_role_category


def _has_vector(entries: DataFrame) -> Column:
    return F.col("has_embedding") if "has_embedding" in entries.columns else F.col("embedding").isNotNull()


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def _counts(entries: DataFrame) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("entries"),
        F.count_if(_has_vector(entries)).alias("with_embeddings"),
    ]


def count_entries(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("entries"))


def list_categories(entries: DataFrame, role: str | None = None) -> DataFrame:
    return filter_role_category(entries, role).select(*GROUP_KEYS).distinct().orderBy(*GROUP_KEYS)


def list_roles(entries: DataFrame) -> DataFrame:
    return entries.select("role").distinct().orderBy("role")


def stats_totals(entries: DataFrame, role: str | None = None) -> DataFrame:
    """One row of totals: size, coverage to one decimal (half to even) and date range."""
    totals = filter_role_category(entries, role).agg(
        *_counts(entries), F.min("created_at").alias("oldest_entry"), F.max("created_at").alias("newest_entry")
    )
    return totals.withColumn("coverage_pct", _percent(F.col("with_embeddings"), F.col("entries")))


def stats_by_category(entries: DataFrame, role: str | None = None) -> DataFrame:
    groups = filter_role_category(entries, role).groupBy(*GROUP_KEYS).agg(*_counts(entries))
    return groups.withColumn("coverage_pct", _percent(F.col("with_embeddings"), F.col("entries")))


def stats_rollup(entries: DataFrame) -> DataFrame:
    """Categories, role totals and the grand total in one pass; totals have NULL keys."""
    groups = entries.rollup(*GROUP_KEYS).agg(F.grouping_id().cast("int").alias("level"), *_counts(entries))
    return groups.withColumn("coverage_pct", _percent(F.col("with_embeddings"), F.col("entries")))


def embedding_health(entries: DataFrame) -> DataFrame:
    """Whole-number coverage per group with its verdict, and a total line (``level`` 'total').

    The total fails when any group fails. An empty table gives no lines and counts as healthy.
    """
    groups = entries.groupBy(*GROUP_KEYS).agg(*_counts(entries))
    pct = F.expr("cast((100 * with_embeddings) div entries as int)")
    verdict = F.when(pct == 100, "ok").when(pct >= 50, "warn").otherwise("fail")
    detail = groups.select(F.lit("group").alias("level"), "*", pct.alias("pct"), verdict.alias("status"))
    total = detail.agg(
        F.sum("entries").alias("entries"), F.sum("with_embeddings").alias("with_embeddings"),
        F.bool_or(F.col("status") == "fail").alias("failed"),
    ).where("entries > 0")
    total = total.select(
        F.lit("total").alias("level"), *[F.lit(None).cast("string").alias(k) for k in GROUP_KEYS],
        "entries", "with_embeddings", pct.alias("pct"), F.when(F.col("failed"), "fail").otherwise("ok").alias("status"),
    )
    return detail.unionByName(total)


def storage_size(table: DataFrame) -> DataFrame:
    """Files and bytes behind a file-based table. No data column is read."""
    files = table.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    ).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
