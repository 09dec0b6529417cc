"""Greedy first-wins resolution of near-duplicates, in id order within each group.

A kept row removes every later row that matches it; a removed row removes nothing. The answer is
the lexicographically first maximal independent set of the match graph, *not* its connected
components.

* Groups up to ``block_rows`` rows are walked whole inside one bounded tile: one shuffle in all.
* Larger groups first fold true twins (same vector, same role in text matching), which always share
  one fate, into their earliest copy: a third of the table being copies of one note costs one row
  per map task. The representatives are compared tile by tile; each row reports only its few
  smallest older matches per tile, so dense clusters do not emit all their pairs. A row that can be
  decided on those is; rows left over (all reported matches removed, more existing) are compared
  again against what is still alive until none is left. Nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels
from ..operators.blocks import BLOCK_ROWS, BlockPlan, blocks_per_tile, large_only, plan_blocks, self_tiles, small_only
from ..operators.pivots import plan_cells, self_cell_tiles
from ..operators.similarity import BUCKET, first_match, in_buckets, key_ddl
from ..schema import GROUP_KEYS
from ..session import materialize

NEIGHBOURS_PER_TILE = 4
# Match lists of one group up to this many rows are resolved in one task; longer ones in rounds.
LOCAL_EDGES = 2_000_000
_KEPT, _REMOVED, _OPEN = "kept", "removed", "open"


def resolve_first_wins(
    rows: DataFrame,
    threshold: float,
    *,
    strict: bool = False,
    keys: Sequence[str] = GROUP_KEYS,
    block_rows: int = BLOCK_ROWS,
    local_edges: int = LOCAL_EDGES,
    neighbours: int = NEIGHBOURS_PER_TILE,
    miss: float | None = None,
) -> DataFrame:
    """Removed rows with their keeper: keys, ``keep_id``, ``remove_id``, ``similarity``.

    ``rows``: keys, ``id``, ``embedding`` and ``_h``, the text key (NULL where text never matters).
    With ``miss``, rows are only compared if they share a signature, whatever the size of their group, at
    that chance of missing a pair at the threshold; the keeper is then the smallest one seen. The default
    is exact.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    keys = list(keys)
    rows = rows.select(*keys, "id", "embedding", "_h")
    if miss is not None:
        return _resolve_large(materialize(rows, "signature-rows"), keys, threshold, strict, block_rows, local_edges, neighbours, miss)
    plan = plan_blocks([rows], keys, block_rows)
    removed = _walk_small(small_only(rows, plan), plan, threshold, strict)
    if plan.large is None:
        return removed
    large = materialize(large_only(rows, plan), "large-groups")
    return removed.unionByName(
        _resolve_large(large, keys, threshold, strict, block_rows, local_edges, neighbours, miss)
    )


def _walk_small(rows: DataFrame, plan: BlockPlan, threshold: float, strict: bool) -> DataFrame:
    keys = list(plan.keys)
    return self_tiles(rows, replace(plan, large=None)).groupBy("_tile").applyInArrow(
        kernels.greedy_kernel(keys, threshold, strict),
        f"{key_ddl(keys)}, keep_id bigint, remove_id bigint, similarity double",
    )


def _resolve_large(rows, keys, threshold, strict, block_rows, local_edges, neighbours, miss) -> DataFrame:
    bare_texts = rows.where("embedding is null").select(*keys, "_h").distinct()
    vectors = rows.where("embedding is not null")
    in_use = vectors.join(bare_texts.withColumn("_u", F.lit(True)), [*keys, "_h"], "left")
    # Text only tells vector rows apart where a row without a vector carries the same text.
    typed = in_use.select(*keys, "id", "embedding", F.when(F.col("_u"), F.col("_h")).alias("_h"))
    typed = typed.unionByName(rows.where("embedding is null"))
    # A vector without length, or a threshold a rounded self-match may miss, gets no twin folding.
    text_ok = threshold < 1.0 or (threshold == 1.0 and not strict)
    foldable = F.when(F.col("embedding").isNull(), F.lit(text_ok)).otherwise(
        F.exists("embedding", lambda x: x != 0) & F.lit(threshold <= 1.0 - 1e-9)
    )
    typed = typed.withColumn("_own", F.when(foldable, F.lit(None).cast("bigint")).otherwise(F.col("id")))
    reps = materialize(
        typed.groupBy(*keys, "embedding", "_h", "_own").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")),
        "representatives",
    )
    decided = _resolve_representatives(
        reps.select(*keys, "id", "embedding", "_h"), keys, threshold, strict, block_rows, local_edges, neighbours, miss
    )
    decided = materialize(decided, "decided")
    # Later copies follow their representative: to its keeper, or to itself where it is kept.
    folded = reps.where("n > 1").select(*keys, "embedding", "_h", F.col("id").alias("rep_id"))
    fate = folded.join(
        decided.select(*keys, F.col("remove_id").alias("rep_id"), "keep_id", "similarity"), [*keys, "rep_id"], "left"
    ).select(
        *keys, "embedding", "_h", "rep_id",
        F.coalesce("keep_id", "rep_id").alias("keep_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
    )
    member, f = typed.where(F.col("_own").isNull()).alias("m"), fate.alias("f")
    same = [F.col(f"m.{k}") == F.col(f"f.{k}") for k in keys]
    # The hash leads so that the sort rarely has to compare whole vectors.
    same += [
        F.xxhash64("m.embedding", "m._h") == F.xxhash64("f.embedding", "f._h"),
        F.col("m.embedding").eqNullSafe(F.col("f.embedding")),
        F.col("m._h").eqNullSafe(F.col("f._h")),
        F.col("m.id") > F.col("f.rep_id"),
    ]
    copies = member.join(f, same).select(
        *[F.col(f"m.{k}").alias(k) for k in keys],
        F.col("f.keep_id"), F.col("m.id").alias("remove_id"), F.col("f.similarity"),
    )
    return decided.unionByName(copies)


def _resolve_representatives(reps, keys, threshold, strict, block_rows, local_edges, neighbours, miss) -> DataFrame:
    """Groups that folding made small are walked at once; the rest go through match lists."""
    if miss is not None:
        edges, status = _decide(reps, keys, threshold, strict, block_rows, local_edges, neighbours, miss)
        return _keepers(reps, edges, status, keys, threshold, strict, block_rows, miss)
    plan = plan_blocks([reps], keys, block_rows)
    if plan.large is None:
        return _walk_small(reps, plan, threshold, strict)
    small = _walk_small(small_only(reps, plan), plan, threshold, strict)
    rows = materialize(large_only(reps, plan), "large-representatives")
    edges, status = _decide(rows, keys, threshold, strict, block_rows, local_edges, neighbours, miss)
    return small.unionByName(_keepers(rows, edges, status, keys, threshold, strict, block_rows, miss))


def _keepers(rows, edges, status, keys, threshold, strict, block_rows, miss) -> DataFrame:
    """The smallest kept match of each removed row.

    Lists hold the smallest matches of a block in order, so a list showing a kept row shows the
    smallest one of its block. Only a cut list of nothing but removed rows that ends below the best
    keeper seen can hide a better one; those rows are looked up among the kept ones.
    """
    kept = status.where(F.col("status") == _KEPT).select(*keys, F.col("id").alias("older_id"), F.lit(True).alias("_k"))
    removed = status.where(F.col("status") == _REMOVED).select(*keys, "id")
    seen = edges.join(removed, [*keys, "id"], "left_semi").join(kept, [*keys, "older_id"], "left")
    lists = seen.groupBy(*keys, "id", "pass", "slot").agg(
        F.max("more").alias("cut"), F.max("older_id").alias("last"),
        F.min(F.when(F.col("_k"), F.col("older_id"))).alias("keeper"),
        F.min_by("similarity", F.when(F.col("_k"), F.col("older_id"))).alias("similarity"),
    )
    ends = F.when(F.col("cut") & F.col("keeper").isNull(), F.col("last"))
    best = materialize(
        lists.groupBy(*keys, "id").agg(
            F.min("keeper").alias("keep_id"), F.min_by("similarity", "keeper").alias("similarity"),
            F.min(ends).alias("hidden_after"),
        ),
        "keepers",
    )
    open_end = F.coalesce(F.col("hidden_after") < F.col("keep_id"), F.lit(False))
    asked = best.where(open_end)
    out = [*keys, "keep_id", F.col("id").alias("remove_id"), "similarity"]
    if asked.isEmpty():
        return best.select(*out)
    looked_up = first_match(
        rows.join(asked.select(*keys, "id"), [*keys, "id"], "left_semi"),
        rows.join(kept.select(*keys, F.col("older_id").alias("id")), [*keys, "id"], "left_semi"),
        threshold, strict=strict, older_only=True, keys=keys, block_rows=block_rows, miss=miss,
    ).select(*keys, "id", F.col("match_id").alias("keep_id"), "similarity")
    both = looked_up.unionByName(asked.select(*keys, "id", "keep_id", "similarity")).groupBy(*keys, "id").agg(
        F.min("keep_id").alias("k"), F.min_by("similarity", "keep_id").alias("similarity")
    ).withColumnRenamed("k", "keep_id")
    return best.where(~open_end).select(*out).unionByName(both.select(*out))


def _decide(rows, keys, threshold, strict, block_rows, local_edges, neighbours, miss):
    """Match lists seen, and the final status of every representative (``cut``: its list was cut)."""
    text_edges = _text_edges(rows, keys, threshold, strict)
    # Cells of all rows hold for what is still compared in later passes.
    vectors = rows.where("embedding is not null").select(*keys, "id", "embedding")
    strip = blocks_per_tile(vectors, block_rows)
    cells = plan_cells(vectors, keys, threshold, block_rows, strip) if miss is None else None
    undecided = rows.select(*keys, "id")
    kept = done = all_edges = None
    for number in count():
        alive = rows.join(undecided.withColumn("undecided", F.lit(True)), [*keys, "id"], "left")
        if kept is None:
            alive = alive.withColumn("undecided", F.lit(True))
        else:
            alive = alive.join(kept.withColumn("_kept", F.lit(True)), [*keys, "id"], "left").where(
                "undecided or _kept"
            ).select(*rows.columns, F.coalesce("undecided", F.lit(False)).alias("undecided"))
        edges = materialize(
            _vector_edges(alive, keys, threshold, strict, block_rows, neighbours, miss, cells, strip).unionByName(
                text_edges.join(undecided, [*keys, "id"], "left_semi")
            ).withColumn("pass", F.lit(number)),
            "match-lists",
        )
        status = _settle(edges, undecided, kept, done, keys, local_edges)
        all_edges = edges if all_edges is None else all_edges.unionByName(edges)
        done = status.where(F.col("status") != _OPEN) if done is None else materialize(
            done.unionByName(status.where(F.col("status") != _OPEN)), "settled"
        )
        undecided = status.where(F.col("status") == _OPEN).select(*keys, "id")
        if undecided.isEmpty():
            return all_edges, done
        kept = done.where(F.col("status") == _KEPT).select(*keys, "id")


def _vector_edges(alive, keys, threshold, strict, block_rows, neighbours, miss, cells, strip) -> DataFrame:
    vectors = alive.where("embedding is not null").select(*keys, "id", "embedding", "undecided")
    if miss is not None:
        (vectors,) = in_buckets([vectors], keys, threshold, miss)
        # A bucket is a block; only one that is too large for a tile is cut.
        vectors = materialize(vectors.drop("_sigs"), "buckets")
        plan = plan_blocks([vectors], [*keys, *BUCKET], block_rows * strip)
    else:
        plan = plan_blocks([vectors], keys, block_rows, strip if cells is None else 1)
    tiles = self_tiles(vectors, plan) if cells is None else self_cell_tiles(vectors, plan, threshold, block_rows, cells)
    return tiles.groupBy("_tile").applyInArrow(
        kernels.older_neighbours_kernel(keys, threshold, strict, neighbours, banded=miss is not None),
        f"{key_ddl(keys)}, id bigint, older_id bigint, similarity double, more boolean, slot bigint",
    )


def _text_edges(rows, keys, threshold, strict) -> DataFrame:
    """A text has at most one row without a vector left, so this is linear in the rows."""
    bare = rows.where("embedding is null").select(*keys, "_h", F.col("id").alias("x"))
    typed = rows.where("embedding is not null and _h is not null").select(*keys, "_h", F.col("id").alias("y"))
    matches = threshold < 1.0 or (threshold == 1.0 and not strict)
    return bare.join(typed, [*keys, "_h"]).where(F.lit(matches)).select(
        *keys, F.greatest("x", "y").alias("id"), F.least("x", "y").alias("older_id"),
        F.lit(1.0).alias("similarity"), F.lit(False).alias("more"), F.lit(-1).cast("bigint").alias("slot"),
    )


def _settle(edges, undecided, kept, done, keys, local_edges) -> DataFrame:
    """Status of each undecided row from the match lists of this pass."""
    lists = edges.groupBy(*keys, "id").agg(F.max("more").alias("cut"))
    status = undecided.join(lists, [*keys, "id"], "left").select(
        *keys, "id",
        F.when(F.col("cut").isNull(), _KEPT).otherwise(_OPEN).alias("status"),
        F.coalesce("cut", F.lit(False)).alias("cut"),
    )
    if done is not None:
        status = status.unionByName(done.select(*keys, "id", "status", "cut"))
    status = materialize(status, "status")
    decide_locally = _local_walk(keys)
    while True:
        known = status.select(*keys, F.col("id").alias("older_id"), F.col("status").alias("older_status"))
        live = edges.join(
            status.where(F.col("status") == _OPEN).select(*keys, "id", "cut"), [*keys, "id"]
        ).join(known, [*keys, "older_id"]).select(*keys, "id", "older_id", "older_status", "cut")
        longest = live.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if not longest:
            fresh = None
        elif longest <= local_edges:
            fresh = live.groupBy(*keys).applyInArrow(decide_locally, f"{key_ddl(keys)}, id bigint, new string")
        else:
            seen = live.groupBy(*keys, "id").agg(
                F.max(F.col("older_status") == _KEPT).alias("hit"),
                F.max(F.col("older_status") == _OPEN).alias("waits"),
                F.max("cut").alias("cut"),
            )
            fresh = seen.select(
                *keys, "id",
                F.when(F.col("hit"), _REMOVED).when(~F.col("waits") & ~F.col("cut"), _KEPT).alias("new"),
            ).where("new is not null")
        if fresh is None:
            break
        fresh = materialize(fresh, "newly-decided")
        status = materialize(
            status.join(fresh, [*keys, "id"], "left").select(
                *keys, "id", F.coalesce("new", "status").alias("status"), "cut"
            ),
            "status",
        )
        if longest <= local_edges or fresh.isEmpty():
            break
    return status.join(undecided, [*keys, "id"], "left_semi")


def _local_walk(keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Settle one group's match list in id order; a row waiting on a cut list stays open."""
    schema = pa.schema([(k, pa.string()) for k in keys] + [("id", pa.int64()), ("new", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        ids, older, cut = (table.column(c).to_numpy() for c in ("id", "older_id", "cut"))
        states = table.column("older_status").to_pylist()
        verdict: dict[int, str] = {}
        order = np.argsort(ids, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
            seen = {verdict.get(int(older[e]), states[e]) for e in own}
            row = int(ids[own[0]])
            if _KEPT in seen:
                verdict[row] = _REMOVED
            elif _OPEN in seen or cut[own[0]]:
                verdict[row] = _OPEN
            else:
                verdict[row] = _KEPT
        settled = [(i, v) for i, v in verdict.items() if v != _OPEN]
        data = {k: pa.array([table.column(k)[0].as_py()] * len(settled), pa.string()) for k in keys}
        data["id"] = pa.array([i for i, _ in settled], pa.int64())
        data["new"] = pa.array([v for _, v in settled], pa.string())
        return pa.table(data, schema=schema)

    return run
