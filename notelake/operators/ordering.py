"""Fixed orders, top-k and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import RECORD_COLUMNS, TIMELINE_LIMIT
from ..session import materialize
from .filters import filter_role_category, filter_since

EXPORT_ORDER = ("category", "created_at", "id")


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def timeline(
    entries: DataFrame,
    role: str,
    last: str | None = None,
    category: str | None = None,
    limit: int = TIMELINE_LIMIT,
    *,
    as_of: date | str,
) -> DataFrame:
    """Newest entries of a role. A negative limit means no cap, zero means none."""
    rows = filter_since(filter_role_category(entries, role, category), last, as_of)
    rows = rows.select(*[c for c in RECORD_COLUMNS if c in entries.columns]).orderBy(*_newest_first())
    return rows if limit < 0 else rows.limit(limit)


def timeline_all_roles(
    entries: DataFrame, last: str | None = None, limit: int = TIMELINE_LIMIT, *, as_of: date | str
) -> DataFrame:
    """The newest ``limit`` entries of every role, with their ``rank``.

    ``rank <= limit`` lets Spark cut each map task to ``limit`` rows per role before the shuffle.
    """
    rows = filter_since(entries, last, as_of)
    rows = rows.select(*[c for c in RECORD_COLUMNS if c in entries.columns])
    newest = Window.partitionBy("role").orderBy(*_newest_first())
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def export_order(entries: DataFrame) -> DataFrame:
    """Category, date, id within role: a range-partitioned sort, no single final task."""
    return entries.orderBy("role", *EXPORT_ORDER)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row per key, pre-aggregated on the map side so hot keys stay cheap.

    ``order`` must tell rows of one key apart.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*").select(*df.columns)


def ranked(df: DataFrame, group: str, order: Sequence[Column], label: str = "ranked") -> DataFrame:
    """``rank`` within ``group`` when one group may be too big for one task.

    Rows are range-partitioned on (group, order), the partition number is written with them, and
    each row's rank is its place in the partition plus the rows of its group before it.
    """
    placed = df.repartitionByRange(F.col(group), *order).withColumn("_p", F.spark_partition_id())
    placed = materialize(placed, label)
    sizes = placed.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_p").orderBy(*order)
    ranks = placed.withColumn("_r", F.row_number().over(inside)).join(offsets, [group, "_p"])
    return ranks.select(*df.columns, (F.col("_r") + F.col("_o")).cast("int").alias("rank"))


def with_next_ids(df: DataFrame, order: Sequence[str], after: int) -> DataFrame:
    """New ids above ``after`` that follow ``order``; gaps are allowed, ties in order are not.

    The global sort is range-partitioned and its partitions are numbered in order. The result is
    written once so that every later use sees the same ids.
    """
    rest = [c for c in df.columns if c != "id"]
    numbered = df.orderBy(*order).select(
        (F.monotonically_increasing_id() + F.lit(after + 1)).alias("id"), *rest
    )
    return materialize(numbered, "new-ids")
