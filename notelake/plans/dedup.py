"""Duplicate clean-up of a stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.blocks import BLOCK_ROWS, only_groups_of
from ..schema import DEDUP_THRESHOLD, GROUP_KEYS
from ..session import materialize, spread_small
from .first_wins import resolve_first_wins


def dedup_find(
    entries: DataFrame,
    threshold: float = DEDUP_THRESHOLD,
    *,
    with_text: bool = True,
    block_rows: int = BLOCK_ROWS,
    miss: float | None = None,
    **tuning: int,
) -> DataFrame:
    """One row per entry to remove: keep_id, remove_id, similarity (4 dp), role, category and texts.

    Exact by default; ``miss`` trades that for signature buckets in groups above ``block_rows``.
    """
    rows = entries.select(*GROUP_KEYS, "id", "embedding", X.text_key(F.col("text")).alias("_h"))
    found = resolve_first_wins(rows, threshold, block_rows=block_rows, miss=miss, **tuning)
    found = found.withColumn("similarity", F.round("similarity", 4))
    return _with_texts(found, entries) if with_text else found


def dedup_exact_text(entries: DataFrame, *, with_text: bool = False) -> DataFrame:
    """Offline form: same normalized text within (role, category), earliest id kept.

    The earliest id comes from a pre-aggregated minimum, so a text that fills a third of the table
    is one row per map task; only texts that do repeat are joined back.
    """
    rows = spread_small(entries.select(*GROUP_KEYS, "id", "text")).select(
        *GROUP_KEYS, "id", X.text_key(F.col("text")).alias("_h")
    )
    firsts = rows.groupBy(*GROUP_KEYS, "_h").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    found = rows.join(firsts.where("n > 1"), [*GROUP_KEYS, "_h"]).where("id > keep_id").select(
        *GROUP_KEYS, "keep_id", F.col("id").alias("remove_id")
    )
    return _with_texts(found, entries) if with_text else found


def _with_texts(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Texts of the reported rows, taken out of the table in one pass for both sides."""
    found = materialize(found, "duplicates")
    named = [found.select(*GROUP_KEYS, F.col(c).alias("id")) for c in ("keep_id", "remove_id")]
    wanted = named[0].unionByName(named[1]).distinct()
    named_only = only_groups_of(entries.select(*GROUP_KEYS, "id", "text"), found, GROUP_KEYS)
    texts = materialize(named_only.join(wanted, [*GROUP_KEYS, "id"], "left_semi"), "texts")
    for side in ("keep", "remove"):
        renamed = texts.withColumnsRenamed({"id": f"{side}_id", "text": f"{side}_text"})
        found = found.join(renamed, [*GROUP_KEYS, f"{side}_id"])
    return found


def dedup_summary(entries: DataFrame, duplicates: DataFrame, *, applied: bool = False) -> DataFrame:
    """Found and removed counts per (role, category); removed stays 0 on a dry run."""
    groups = entries.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("entries"))
    found = duplicates.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("f"))
    found_count = F.coalesce("f", F.lit(0))
    return groups.join(found, list(GROUP_KEYS), "left").select(
        *GROUP_KEYS, "entries", found_count.cast("bigint").alias("found"),
        (found_count if applied else F.lit(0)).cast("bigint").alias("removed"),
    )


def dedup_apply(entries: DataFrame, duplicates: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """The table without the removed rows."""
    gone = duplicates.select(*keys, F.col("remove_id").alias("id"))
    return entries.join(gone, [*keys, "id"], "left_anti")
