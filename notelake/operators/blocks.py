"""Bounded tiles for comparing rows inside a group without gathering the group.

A group (equal ``keys``) with at most ``block_rows`` rows is one tile; many such groups share a
bundle so that a task call is not spent on ten rows. A larger group is hashed into blocks of about
``block_rows`` rows, and each pair of blocks is its own tile. No task ever holds more than two
blocks, whatever share of the table one group owns, and no row pair is ever shuffled: rows are
replicated per block, and the tile kernel emits matches only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread_small

BLOCK_ROWS = 8192
# Blocks that are smaller than this share a tile: bytes of vectors, and rows, of one side of it.
TILE_BYTES = 8 << 20
TILE_ROWS = 32_768
# A list of large groups up to this length is shipped to every executor; a longer one is joined
# by shuffle.
MAX_BROADCAST_GROUPS = 10_000
# A side whose measured size is at most this goes to every executor; a larger one meets the other
# side in tiles.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class BlockPlan:
    keys: tuple[str, ...]
    bundles: int
    large: DataFrame | None
    broadcast_large: bool
    # So many neighbouring blocks make one side of a tile.
    strip: int = 1


def blocks_per_tile(rows: DataFrame, block_rows: int) -> int:
    """How many blocks of ``block_rows`` rows one side of a tile takes, by the bytes of the widest vector."""
    widest = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    return max(1, min(TILE_ROWS, TILE_BYTES // (4 * max(widest, 1))) // block_rows)


def plan_blocks(
    sides: Sequence[DataFrame], keys: Sequence[str], block_rows: int = BLOCK_ROWS, strip: int = 1
) -> BlockPlan:
    """Size the groups with one column-pruned aggregate; only its one-row summary is fetched.

    With ``strip``, tiles and bundles take so many blocks on a side (for ``self_tiles`` only).
    """
    keys = tuple(keys)
    counted = [
        side.select(*keys, *[F.lit(int(n == k)).alias(f"_n{k}") for k in range(len(sides))])
        for n, side in enumerate(sides)
    ]
    rows = counted[0]
    for other in counted[1:]:
        rows = rows.unionByName(other)
    names = [f"_n{k}" for k in range(len(sides))]
    groups = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    summary = groups.agg(
        F.sum(total).alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.max(F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])).alias("top"),
    ).first()
    spark = sides[0].sparkSession
    if not summary["groups"]:
        return BlockPlan(keys, 1, None, False)
    parallel = 2 * spark.sparkContext.defaultParallelism
    bundles = max(-(-int(summary["rows"]) // (block_rows * strip)), min(parallel, int(summary["groups"])))
    if summary["top"] <= block_rows:
        return BlockPlan(keys, bundles, None, False, strip)
    big = F.col(names[0]) > block_rows
    for name in names[1:]:
        big = big | (F.col(name) > block_rows)
    large = groups.where(big).select(
        *keys,
        *[F.greatest(F.ceil(F.col(n) / block_rows), F.lit(1)).cast("int").alias(f"_nb{k}")
          for k, n in enumerate(names)],
    )
    listed = large.take(MAX_BROADCAST_GROUPS + 1)
    if len(listed) <= MAX_BROADCAST_GROUPS:
        return BlockPlan(keys, bundles, spark.createDataFrame(listed, large.schema), True, strip)
    return BlockPlan(keys, bundles, large, False, strip)


def only_groups_of(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leave out groups ``other`` does not have, if that list is short enough to ship.

    The shipped list also prunes the partition directories of a stored table. With a long list
    nothing is dropped here: a second shuffle would cost more than it saves.
    """
    groups = other.select(*keys).distinct()
    listed = groups.take(MAX_BROADCAST_GROUPS + 1)
    if len(listed) > MAX_BROADCAST_GROUPS:
        return df
    shipped = df.sparkSession.createDataFrame(listed, groups.schema)
    return df.join(F.broadcast(shipped), list(keys), "left_semi")


def with_block_counts(df: DataFrame, plan: BlockPlan, sides: int = 1) -> DataFrame:
    """Add ``_nb0`` (and ``_nb1``): the number of blocks of the row's group on each side."""
    names = [f"_nb{k}" for k in range(sides)]
    if plan.large is None:
        return df.select("*", *[F.lit(1).alias(n) for n in names])
    large = F.broadcast(plan.large) if plan.broadcast_large else plan.large
    keep = [c for c in df.columns]
    joined = df.join(large, list(plan.keys), "left")
    return joined.select(*keep, *[F.coalesce(F.col(n), F.lit(1)).alias(n) for n in names])


def large_only(df: DataFrame, plan: BlockPlan) -> DataFrame:
    if plan.large is None:
        return df.limit(0)
    large = plan.large.select(*plan.keys)
    return df.join(F.broadcast(large) if plan.broadcast_large else large, list(plan.keys), "left_semi")


def small_only(df: DataFrame, plan: BlockPlan) -> DataFrame:
    if plan.large is None:
        return df
    large = plan.large.select(*plan.keys)
    return df.join(F.broadcast(large) if plan.broadcast_large else large, list(plan.keys), "left_anti")


def block_of(row_id: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(row_id)), blocks.cast("long")).cast("int")


def tile_of(keys: Sequence[str]) -> Column:
    """The tile of blocks ``_i`` and ``_j`` of a large group."""
    return F.xxhash64(*[F.col(k) for k in keys], F.col("_i"), F.col("_j"))


def _tile(plan: BlockPlan, is_large: Column) -> Column:
    group = [F.col(k) for k in plan.keys]
    return F.when(is_large, tile_of(plan.keys)).otherwise(
        F.pmod(F.xxhash64(*group), F.lit(plan.bundles).cast("long"))
    )


def self_tiles(df: DataFrame, plan: BlockPlan, row_id: str = "id") -> DataFrame:
    """Rows replicated to every tile (i <= j) of their group: ``_tile``, ``_i``, ``_j``, ``_b``.

    With strips of several blocks, these are the strips, and ``_slot`` is the row's block: a row is copied once per strip,
    not once per block, and groups of one strip share bundles.
    """
    rows = with_block_counts(df, plan).withColumn("_b", block_of(row_id, F.col("_nb0")))
    if plan.large is None:
        rows = rows.select("*", F.lit(0).alias("_i"), F.lit(0).alias("_j"))
    else:
        if plan.strip > 1:
            rows = rows.withColumnRenamed("_b", "_slot").withColumns({
                "_b": F.floor(F.col("_slot") / plan.strip).cast("int"), "_nb0": F.ceil(F.col("_nb0") / plan.strip).cast("int")})
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_nb0") - 1)).alias("_k")).select(
            "*", F.least("_b", "_k").alias("_i"), F.greatest("_b", "_k").alias("_j")
        ).drop("_k")
    return rows.withColumn("_tile", _tile(plan, F.col("_nb0") > 1)).drop("_nb0")


def cross_tiles(left: DataFrame, right: DataFrame, plan: BlockPlan, row_id: str = "id") -> DataFrame:
    """Union of both sides (``_side`` 0 / 1, same columns), replicated to every block pair (i, j)."""
    parts = []
    for side, df in enumerate((left, right)):
        rows = with_block_counts(df, plan, 2).withColumn("_b", block_of(row_id, F.col(f"_nb{side}")))
        if plan.large is None:
            rows = rows.select("*", F.lit(0).alias("_i"), F.lit(0).alias("_j"))
        else:
            other = F.explode(F.sequence(F.lit(0), F.col(f"_nb{1 - side}") - 1))
            rows = rows.select("*", other.alias("_k")).select(
                "*",
                (F.col("_b") if side == 0 else F.col("_k")).alias("_i"),
                (F.col("_k") if side == 0 else F.col("_b")).alias("_j"),
            ).drop("_k")
        is_large = (F.col("_nb0") > 1) | (F.col("_nb1") > 1)
        parts.append(
            rows.withColumn("_tile", _tile(plan, is_large))
            .withColumn("_side", F.lit(side))
            .drop("_nb0", "_nb1")
        )
    return parts[0].unionByName(parts[1])


def compare_sides(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    kernel: Callable[[pa.Table], pa.Table],
    schema: str,
    tiles: Callable[[], DataFrame],
) -> DataFrame:
    """Run a two-sided kernel over all of ``left`` x ``right`` within equal keys.

    A right side measured to be small is shipped, so that a small batch meets a large table in one
    scan without a shuffle; its kernel output is per scanned batch. Otherwise both go to ``tiles``.
    """
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in right.dtypes if kind == "string"]
    lists = [F.coalesce(F.octet_length(F.array_join(c, " ")), F.lit(0)) for c, kind in right.dtypes if kind == "array<string>"]
    volume = right.agg(F.sum(sum([*strings, *lists], 4 * F.size("embedding") + 256))).first()[0] or 0
    if volume > BROADCAST_BYTES:
        return tiles().groupBy("_tile").applyInArrow(kernel, schema)
    shipped = left.sparkSession.sparkContext.broadcast(right.select(*left.columns).toArrow())

    def placed(table: pa.Table, side: int) -> pa.Table:
        for name, value in (("_side", side), ("_i", 0), ("_j", 0), ("_b", 0)):
            table = table.append_column(name, pa.repeat(pa.scalar(value, pa.int32()), table.num_rows))
        return table

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            other = shipped.value.cast(table.schema)
            for key in keys:
                other = other.filter(pc.is_in(other.column(key), pc.unique(table.column(key))))
            yield from kernel(pa.concat_tables([placed(table, 0), placed(other, 1)])).to_batches()

    return spread_small(left).mapInArrow(scan, schema)
