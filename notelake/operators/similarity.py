"""Similarity joins inside (role, category)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DEDUP_THRESHOLD, GROUP_KEYS
from . import kernels
from .blocks import BLOCK_ROWS, compare_sides, cross_tiles, only_groups_of, plan_blocks, self_tiles
from .pivots import cross_cell_tiles, self_cell_tiles
from .sketches import sketched_pairs

LSH_MISS = 1e-6
BUCKET = ("_band", "_sig")


def key_ddl(keys: Sequence[str]) -> str:
    return ", ".join(f"{k} string" for k in keys)


def _pair_ddl(keys: Sequence[str]) -> str:
    return f"{key_ddl(keys)}, id_a bigint, id_b bigint, similarity double"


def _vector_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(F.col("embedding").isNotNull()).select(*keys, "id", "embedding")


def text_pairs(entries: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Pairs decided by equal text because at least one side has no vector: a pure equi-join."""
    rows = entries.select(
        *keys, "id", F.col("embedding").isNotNull().alias("v"), X.text_key(F.col("text")).alias("h")
    )
    bare = rows.where(~F.col("v"))
    both_bare = bare.alias("a").join(bare.alias("b"), [*keys, "h"]).where("a.id < b.id")
    mixed = bare.alias("a").join(rows.where("v").alias("b"), [*keys, "h"])
    found = both_bare.select(*keys, F.col("a.id").alias("x"), F.col("b.id").alias("y")).unionByName(
        mixed.select(*keys, F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    )
    return found.select(
        *keys, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.lit(1.0).alias("similarity")
    )


def vector_pairs(
    entries: DataFrame,
    threshold: float,
    *,
    strict: bool = False,
    keys: Sequence[str] = GROUP_KEYS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    rows = _vector_rows(entries, keys)
    tiles = self_cell_tiles(rows, plan_blocks([rows], keys, block_rows), threshold, block_rows)
    return tiles.groupBy("_tile").applyInArrow(
        kernels.pair_kernel(list(keys), threshold, strict), _pair_ddl(keys)
    )


def similarity_self_join(
    entries: DataFrame,
    threshold: float = DEDUP_THRESHOLD,
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every pair (id_a < id_b) of one (role, category) with similarity >= threshold.

    Cosine when both rows have vectors, else 1.0 on equal normalized text. The threshold must be
    positive: at zero or below every text comparison would match.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    pairs = vector_pairs(entries, threshold, block_rows=block_rows)
    return pairs.unionByName(text_pairs(entries)) if threshold <= 1.0 else pairs


def lsh_parameters(threshold: float, largest_group: int, miss: float) -> tuple[int, int]:
    """Bits per signature and number of bands that miss a pair at the threshold with at most ``miss``."""
    same_bit = 1.0 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    # About 256 unrelated rows per bucket: a bit less makes fewer bands, and each of them sends every vector once.
    bits = max(4, min(30, math.ceil(math.log2(max(2, largest_group))) - 8))
    bands = math.ceil(math.log(miss) / math.log1p(-(same_bit**bits)))
    return bits, max(1, bands)


def with_signatures(rows: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """Random-hyperplane signatures: ``_sigs``, one ``bits``-bit number per band."""

    @F.pandas_udf("array<int>")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            out = np.empty(len(batch), object)
            sizes = batch.map(len).to_numpy()
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * bands))
                at = np.flatnonzero(sizes == dim)
                sides = np.stack(batch.iloc[at].to_list()).astype(np.float64) @ planes[dim] >= 0
                numbers = sides.reshape(len(at), bands, bits) @ weights
                for place, row in zip(at, numbers.astype(np.int32)):
                    out[place] = row
            yield pd.Series(out)

    return rows.withColumn("_sigs", signatures("embedding"))


def in_buckets(
    sides: Sequence[DataFrame], keys: Sequence[str], threshold: float, miss: float, seed: int = 17
) -> list[DataFrame]:
    """Each side once per band, with its bucket (``_band``, ``_sig``) and all its signatures."""
    largest = 0
    for side in sides:
        largest += side.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    bits, bands = lsh_parameters(threshold, largest, miss)
    signed = [with_signatures(side, bits, bands, seed) for side in sides]
    return [side.select("*", F.posexplode("_sigs").alias("_band", "_sig")) for side in signed]


def similarity_join_lsh(
    entries: DataFrame, threshold: float = DEDUP_THRESHOLD, *, miss: float = LSH_MISS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Vector pairs as in :func:`similarity_self_join`, comparing only rows that share a signature, and vectors only of those with close sketches.

    Every pair is decided on the exact cosine, so nothing false comes out; a true pair at the
    threshold is missed with probability ``miss``, closer pairs with less. Buckets are tiled like
    groups, so a bucket of copies never lands on one task.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    # A vector without a direction matches nothing, and all its signs are alike.
    rows = _vector_rows(entries, GROUP_KEYS).where(F.exists("embedding", lambda x: x != 0))
    return sketched_pairs(rows, threshold, miss, GROUP_KEYS, block_rows=block_rows)


def first_match(
    incoming: DataFrame,
    stored: DataFrame,
    threshold: float,
    *,
    strict: bool = True,
    older_only: bool = False,
    keys: Sequence[str] = GROUP_KEYS,
    block_rows: int = BLOCK_ROWS,
    miss: float | None = None,
) -> DataFrame:
    """Per incoming row with a match: the smallest matching stored id and its similarity.

    A tile yields at most one line per incoming row, however many stored copies match it. With
    ``miss``, rows are only compared if they share a signature (see :func:`similarity_join_lsh`), at any size.
    """
    left, right = _vector_rows(stored, keys), _vector_rows(incoming, keys)
    left = only_groups_of(left, right, keys)

    def tiles() -> DataFrame:
        if miss is None:
            return cross_cell_tiles(left, right, plan_blocks([left, right], keys, block_rows), threshold, block_rows)
        sides = [side.drop("_sigs") for side in in_buckets([left, right], keys, threshold, miss)]
        return cross_tiles(*sides, plan_blocks(sides, [*keys, *BUCKET], block_rows))

    banded = miss is not None
    kernel = kernels.first_match_kernel(list(keys), threshold, strict, older_only, banded)
    schema = f"{key_ddl(keys)}, id bigint, match_id bigint, similarity double"
    # The argument alone decides between exact and signatures, not the size of a side.
    hits = tiles().groupBy("_tile").applyInArrow(kernel, schema) if banded else compare_sides(left, right, keys, kernel, schema, tiles)
    return hits.groupBy(*keys, "id").agg(
        F.min("match_id").alias("match_id"), F.min_by("similarity", "match_id").alias("similarity")
    )


def cross_similarity_join(
    incoming: DataFrame, stored: DataFrame, threshold: float = DEDUP_THRESHOLD, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Incoming rows that conflict (cosine > threshold) with a stored row, and the first such row."""
    return first_match(incoming, stored, threshold, strict=True, block_rows=block_rows)


def anti_join_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose exact (role, category, text) is not stored yet."""
    # Only the import's groups are read, digests keep whole texts out of the shuffle, and of the stored
    # ones only those that the import asks for go on.
    keys = [*GROUP_KEYS, "_t"]
    probe = incoming.withColumn("_t", X.digest(F.col("text")))
    known = only_groups_of(stored, incoming, GROUP_KEYS).select(*GROUP_KEYS, X.digest(F.col("text")).alias("_t"))
    known = known.join(probe.select(*keys).distinct(), keys, "left_semi").distinct()
    return probe.join(known, keys, "left_anti").drop("_t")
