"""Batch admission: which incoming notes are new, and what the others repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.blocks import BLOCK_ROWS, only_groups_of
from ..operators.filters import validate_entries
from ..operators.similarity import first_match
from ..schema import DEDUP_THRESHOLD, GROUP_KEYS
from ..session import materialize
from .first_wins import resolve_first_wins

STORED, BATCH = "stored", "batch"


def admit_batch(
    incoming: DataFrame,
    stored: DataFrame,
    threshold: float = DEDUP_THRESHOLD,
    *,
    with_text: bool = True,
    block_rows: int = BLOCK_ROWS,
    miss: float | None = None,
) -> DataFrame:
    """Every incoming row with its verdict, as if stored one by one in ``id`` order.

    A row with a vector conflicts with stored or earlier admitted vectors above the threshold; text
    plays no part. A row without one conflicts with an equal normalized text among all stored and
    earlier admitted rows. Adds ``admitted``, ``reason``, ``conflict_source``, ``conflict_id`` and
    ``conflict_text``; the conflict is the first such row, stored ones before those of the batch.
    Exact by default; ``miss`` compares only vectors that share a signature.
    """
    checked = validate_entries(incoming)
    valid = checked.where("reject_reason is null")
    vectors = valid.where("embedding is not null").select(*GROUP_KEYS, "id", "embedding", X.text_key(F.col("text")).alias("_h"))
    by_vector = _vector_conflicts(vectors, stored, threshold, block_rows, miss)
    bare = valid.where("embedding is null").select(*GROUP_KEYS, "id", X.text_key(F.col("text")).alias("_h"))
    admitted_vectors = vectors.join(by_vector, [*GROUP_KEYS, "id"], "left_anti")
    # Stored texts only matter where a row has nothing but its text, and only in the groups of such rows.
    if not bare.isEmpty():
        by_vector = by_vector.unionByName(_text_conflicts(bare, admitted_vectors, only_groups_of(stored, bare, GROUP_KEYS)))
    conflicts = materialize(by_vector, "conflicts")
    verdict = checked.join(conflicts, [*GROUP_KEYS, "id"], "left").withColumn(
        "reason", F.coalesce("reject_reason", F.when(F.col("conflict_id").isNotNull(), "duplicate"))
    )
    verdict = verdict.withColumn("admitted", F.col("reason").isNull()).drop("reject_reason")
    return _with_conflict_text(verdict, conflicts, incoming, stored) if with_text else verdict


def _vector_conflicts(vectors, stored, threshold, block_rows, miss) -> DataFrame:
    against_stored = first_match(vectors, stored, threshold, strict=True, block_rows=block_rows, miss=miss).select(
        *GROUP_KEYS, "id", F.lit(STORED).alias("conflict_source"), F.col("match_id").alias("conflict_id")
    )
    against_stored = materialize(against_stored, "stored-conflicts")
    fresh = vectors.join(against_stored, [*GROUP_KEYS, "id"], "left_anti")
    inside = resolve_first_wins(
        fresh.withColumn("_h", F.lit(None).cast("string")), threshold, strict=True, block_rows=block_rows, miss=miss
    ).select(
        *GROUP_KEYS, F.col("remove_id").alias("id"),
        F.lit(BATCH).alias("conflict_source"), F.col("keep_id").alias("conflict_id"),
    )
    return against_stored.unionByName(materialize(inside, "batch-conflicts"))


def _text_conflicts(bare: DataFrame, admitted_vectors: DataFrame, stored: DataFrame) -> DataFrame:
    """Equal text is transitive, so the earliest holder of a text decides: no rounds needed."""
    keys = [*GROUP_KEYS, "_h"]
    asked = bare.select(*keys).distinct()
    in_table = stored.select(*GROUP_KEYS, "id", X.text_key(F.col("text")).alias("_h"))
    in_table = in_table.join(asked, keys, "left_semi").groupBy(*keys).agg(F.min("id").alias("s"))
    in_batch = admitted_vectors.select(*keys, "id").join(asked, keys, "left_semi").unionByName(
        bare.select(*keys, "id")
    ).groupBy(*keys).agg(F.min("id").alias("b"))
    firsts = in_batch.join(in_table, keys, "left")
    found = bare.join(firsts, keys).where(F.col("s").isNotNull() | (F.col("b") < F.col("id")))
    return found.select(
        *GROUP_KEYS, "id", F.when(F.col("s").isNotNull(), STORED).otherwise(BATCH).alias("conflict_source"),
        F.coalesce("s", "b").alias("conflict_id"),
    )


def _with_conflict_text(verdict: DataFrame, conflicts: DataFrame, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    texts = [
        df.select(*GROUP_KEYS, F.lit(source).alias("conflict_source"), F.col("id").alias("conflict_id"),
                  F.col("text").alias("conflict_text"))
        for df, source in ((stored, STORED), (incoming, BATCH))
    ]
    named = [*GROUP_KEYS, "conflict_source", "conflict_id"]
    # Only texts that are reported travel further than the semi-join, and only their groups are read.
    wanted = conflicts.select(*named).distinct()
    texts[0] = only_groups_of(texts[0], conflicts.where(F.col("conflict_source") == STORED), GROUP_KEYS)
    known = texts[0].unionByName(texts[1]).join(wanted, named, "left_semi")
    return verdict.join(known, named, "left")


def admitted_rows(verdict: DataFrame) -> DataFrame:
    extra = ("admitted", "reason", "conflict_source", "conflict_id", "conflict_text")
    return verdict.where("admitted").drop(*extra)


def rejected_rows(verdict: DataFrame) -> DataFrame:
    return verdict.where("not admitted").drop("admitted", "embedding")
