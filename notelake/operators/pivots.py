"""Metric cells for comparing the vectors of a large group, in place of all pairs of its blocks.

Angles obey the triangle inequality. With pivots p, a row y at home in the cell of its nearest pivot c, and a
match x of y at an angle of at most a:

    angle(x, c) <= angle(y, c) + a <= radius(c) + a                 the cell's radius: its farthest row
    angle(x, c) <= angle(y, c) + a <= angle(y, c') + a <= angle(x, c') + 2 a    for every other pivot c'

So x needs to meet only the cells that pass both. A cell has as many blocks as its rows need; a tile is a pair of
blocks, as in ``blocks``, but a row goes only to the tiles of blocks in cells that it can reach. On clustered
vectors that is a few; on vectors without structure it is all of them, and then the plain grid is used.

Pivots are fitted on a bounded sample of each group, spread out over it. They decide how well cells prune,
never which pairs are found. What is shipped is bounded: the pivots of all groups together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Block, VectorColumn
from ..session import materialize
from .blocks import MAX_BROADCAST_GROUPS, BlockPlan, cross_tiles, large_only, self_tiles, small_only, tile_of

# Pivots of one group, rows of it that they are chosen from, and bytes of all pivots together, at most.
MAX_PIVOTS = 512
CANDIDATES_PER_PIVOT = 4
SHIPPED_BYTES = 32 << 20
# The grid is used unless cells spare this share of its row copies.
WORTH = 0.5
# Rounding of angles, on the generous side.
_SLACK = 1e-5


@dataclass
class Cells:
    """The cells of one group and dimension."""

    pivots: np.ndarray
    radius: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.pivots.T, -1.0, 1.0))

    def reached(self, angles: np.ndarray, reach: float) -> np.ndarray:
        """Which cells hold rows within ``reach`` of each row."""
        nearest = angles.min(axis=1, keepdims=True)
        return (angles <= np.minimum(self.radius[None, :] + reach, nearest + 2 * reach) + _SLACK) & (self.blocks > 0)[None, :]


Key = tuple[tuple[str, ...], int]


def spread_out(vectors: np.ndarray, wanted: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those before it."""
    chosen = [0]
    closest = vectors @ vectors[0]
    while len(chosen) < wanted:
        far = int(closest.argmin())
        if closest[far] >= 1.0 - 1e-12:
            break
        chosen.append(far)
        np.maximum(closest, vectors @ vectors[far], out=closest)
    return vectors[chosen]


def _grouped(table: pa.RecordBatch | pa.Table, keys: Sequence[str], vectors: VectorColumn) -> Iterator[tuple[Key, np.ndarray]]:
    """Row numbers of each group and dimension."""
    groups: dict[Key, list[int]] = {}
    columns = [table.column(k).to_pylist() for k in keys]
    for i, key in enumerate(zip(*columns, vectors.dims.tolist())):
        groups.setdefault((key[:-1], key[-1]), []).append(i)
    for key, rows in groups.items():
        yield key, np.array(rows)


def _unit(vectors: VectorColumn, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a direction, and their unit vectors in double."""
    block = Block(vectors.block(rows).values)
    some = np.flatnonzero(block.norms > 0)
    return rows[some], block.values[some].astype(np.float64) / block.norms[some][:, None]


def plan_cells(rows: DataFrame, keys: Sequence[str], threshold: float, block_rows: int, strip: int = 1) -> dict[Key, Cells] | None:
    """Cells of all groups of ``rows`` (keys, id, embedding); None where the grid, with ``strip`` blocks on a tile's side, does as well.

    ``rows``: the members of large groups only. Two passes over them: counts and a sample, then the cells' sizes.
    """
    if not 0.0 < threshold <= 1.0:
        return None
    dims = F.size("embedding").alias("dim")
    counts = rows.groupBy(*keys, dims).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    sizes = counts.limit(MAX_BROADCAST_GROUPS + 1).collect()
    if len(sizes) > MAX_BROADCAST_GROUPS:
        return None
    wanted = {(tuple(r[k] for k in keys), r["dim"]): min(MAX_PIVOTS, -(-2 * r["n"] // block_rows)) for r in sizes}
    if not wanted or sum(8 * n * dim for (_, dim), n in wanted.items()) > SHIPPED_BYTES:
        return None
    spark = rows.sparkSession
    share = spark.createDataFrame(
        [(*key, dim, min(1.0, CANDIDATES_PER_PIVOT * wanted[key, dim] / r["n"])) for (key, dim), r in zip(wanted, sizes)],
        ", ".join([*[f"{k} string" for k in keys], "dim int", "_share double"]))
    drawn = rows.select(*keys, "id", "embedding", dims).join(F.broadcast(share), [*keys, "dim"])
    sample = drawn.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30)).select(*keys, "embedding").toArrow()
    vectors = VectorColumn(sample.column("embedding"))
    cells: dict[Key, Cells] = {}
    drawn_rows: dict[Key, np.ndarray] = {}
    for key, some in _grouped(sample, keys, vectors):
        _, unit = _unit(vectors, some)
        if len(unit):
            cells[key] = Cells(spread_out(unit, wanted[key]))
            drawn_rows[key] = unit
    if cells.keys() != wanted.keys():
        return None
    for r in materialize(rows.select(*keys, "embedding").mapInArrow(_measure(list(keys), cells), f"{_ddl(keys)}, dim int, cell int, n bigint, radius double")
                         .groupBy(*keys, "dim", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")), "cells").collect():
        here = cells[tuple(r[k] for k in keys), r["dim"]]
        if here.radius is None:
            here.radius, here.blocks = np.zeros(len(here.pivots)), np.zeros(len(here.pivots), np.int64)
        here.radius[r["cell"]], here.blocks[r["cell"]] = r["radius"], -(-r["n"] // block_rows)
    reach = math.acos(threshold)
    copies = grid = 0.0
    for (key, dim), unit in drawn_rows.items():
        here, r = cells[key, dim], next(r for r in sizes if (tuple(r[k] for k in keys), r["dim"]) == (key, dim))
        copies += r["n"] * float((here.reached(here.angles(unit), reach) * here.blocks[None, :]).sum(axis=1).mean())
        grid += r["n"] * -(-r["n"] // (block_rows * strip))
    return cells if copies < WORTH * grid else None


def _ddl(keys: Sequence[str]) -> str:
    return ", ".join(f"{k} string" for k in keys)


def _measure(keys: list[str], cells: dict[Key, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = VectorColumn(batch.column("embedding"))
            for key, rows in _grouped(batch, keys, vectors):
                if key not in cells:
                    continue
                rows, unit = _unit(vectors, rows)
                if not len(rows):
                    continue
                angles = cells[key].angles(unit)
                home = angles.argmin(axis=1)
                each, n = np.unique(home, return_counts=True)
                radius = np.zeros(len(cells[key].pivots))
                np.maximum.at(radius, home, angles.min(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v] * len(each), pa.string()) for v in key[0]], pa.array([key[1]] * len(each), pa.int32()), pa.array(each, pa.int32()), pa.array(n, pa.int64()),
                     pa.array(radius[each])], names=[*keys, "dim", "cell", "n", "radius"])

    return run


def with_cells(rows: DataFrame, keys: Sequence[str], cells: dict[Key, Cells], threshold: float) -> DataFrame:
    """Add ``_b``, the row's block, and ``_reach``, all blocks it has to meet, its own included.

    Blocks are numbered through a group; dimensions have numbers of their own. Rows without a direction match nothing and go.
    """
    reach, names = math.acos(threshold), list(keys)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = VectorColumn(batch.column("embedding"))
            ids = batch.column("id").to_numpy()
            for key, some in _grouped(batch, names, vectors):
                # Fewer vectors of a dimension than a block holds are one block.
                here = cells.get(key)
                if here is None:
                    yield _placed(batch, some, np.zeros(len(some), np.int64), np.arange(len(some) + 1), np.zeros(len(some), np.int64))
                    continue
                some, unit = _unit(vectors, some)
                if not len(some):
                    continue
                first = np.cumsum(here.blocks) - here.blocks
                angles = here.angles(unit)
                home = angles.argmin(axis=1)
                # A spread of the ids over the cell's blocks.
                mixed = (ids[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                block = first[home] + mixed % here.blocks[home]
                row, cell = np.nonzero(here.reached(angles, reach))
                number = here.blocks[cell]
                before = np.cumsum(number) - number
                flat = np.arange(int(number.sum())) - np.repeat(before, number) + np.repeat(first[cell], number)
                per_row = np.bincount(row, number, len(some)).astype(np.int64)
                yield _placed(batch, some, block, np.append(0, np.cumsum(per_row)), flat)

    def _placed(batch, some, block, bounds, flat) -> pa.RecordBatch:
        part = batch.take(pa.array(some))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(block, pa.int32()), lists], names=[*columns, "_b", "_reach"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _b int, _reach array<int>"
    return rows.mapInArrow(run, schema)


# Tiles -----------------------------------------------------------------------------------------------


def _reaching(rows: DataFrame, keys: Sequence[str], side: int | None = None) -> DataFrame:
    """Rows with cells, once per block they have to meet: ``_tile``, ``_i``, ``_j``, ``_b``."""
    each = rows.select(*[c for c in rows.columns if c != "_reach"], F.explode("_reach").alias("_k"))
    if side is None:
        i, j = F.least("_b", "_k"), F.greatest("_b", "_k")
    else:
        i, j = (F.col("_b"), F.col("_k")) if side == 0 else (F.col("_k"), F.col("_b"))
    each = each.withColumns({"_i": i, "_j": j}).drop("_k")
    return each.withColumn("_tile", tile_of(keys))


def self_cell_tiles(df: DataFrame, plan: BlockPlan, threshold: float, block_rows: int, cells: dict[Key, Cells] | None = None) -> DataFrame:
    """As ``self_tiles``; rows of large groups go only to the tiles of cells in reach. ``cells``: at hand for these or more rows."""
    if plan.large is None:
        return self_tiles(df, plan)
    large = large_only(df, plan)
    cells = cells or plan_cells(large, plan.keys, threshold, block_rows)
    if cells is None:
        return self_tiles(df, plan)
    small = self_tiles(small_only(df, plan), replace(plan, large=None))
    return small.unionByName(_reaching(with_cells(large, plan.keys, cells, threshold), plan.keys))


def cross_cell_tiles(left: DataFrame, right: DataFrame, plan: BlockPlan, threshold: float, block_rows: int) -> DataFrame:
    """As ``cross_tiles``; rows of large groups go only to the tiles of cells in reach."""
    if plan.large is None:
        return cross_tiles(left, right, plan)
    sides = [large_only(side, plan) for side in (left, right)]
    both = [side.select(*plan.keys, "id", "embedding") for side in sides]
    cells = plan_cells(both[0].unionByName(both[1]), plan.keys, threshold, block_rows)
    if cells is None:
        return cross_tiles(left, right, plan)
    out = cross_tiles(small_only(left, plan), small_only(right, plan), replace(plan, large=None))
    for number, side in enumerate(sides):
        placed = _reaching(with_cells(side, plan.keys, cells, threshold), plan.keys, number)
        out = out.unionByName(placed.withColumn("_side", F.lit(number)))
    return out
