"""Semantic search with keyword fallback, for one query or for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.vectors import Block, VectorColumn, exact_cosine
from ..schema import GROUP_KEYS, SEARCH_THRESHOLD
from ..session import materialize, spread_small
from . import blocks, kernels, trigrams
from .blocks import BLOCK_ROWS, compare_sides, only_groups_of, plan_blocks
from .filters import filter_role_category, filter_tag, may_hold
from .ordering import ranked
from .pivots import cross_cell_tiles
from .similarity import key_ddl

if TYPE_CHECKING:
    from ..sources.keyword_index import KeywordIndex

_NO_TAGS = "cast(null as array<string>)"
_PRE_RANK_SLICES = 64


def _capped(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit is not None and limit > 0 else df


def keyword_search(entries: DataFrame, query: str, limit: int | None = None, *, index: KeywordIndex | None = None) -> DataFrame:
    """Entries holding at least half of the keywords, in id order, with their ``score``.

    With a stored ``index`` of the entries, only those listed under a rare trigram of a keyword, and later ones, are looked at.
    """
    words, hay = X.query_words(query), X.haystack(F.col("text"), F.col("tags"))
    if index is not None:
        asked = X.split_words(query)
        entries = may_hold(entries, asked, len(asked) - max(-(-len(asked) // 2), 1), index)
    rows = spread_small(entries).where(X.keyword_match(words, hay)).withColumn("score", X.keyword_hits(words, hay))
    return _capped(rows.orderBy("id"), limit)


def semantic_search(
    entries: DataFrame, vector: Sequence[float], limit: int | None = None, threshold: float = SEARCH_THRESHOLD
) -> DataFrame:
    """Entries with cosine > threshold to one vector, best first. The table is not shuffled."""
    wanted = np.asarray(vector, np.float64)[None, :]
    schema = pa.schema(
        [("id", pa.int64()), ("role", pa.string()), ("category", pa.string()), ("similarity", pa.float64())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = Block(wanted)
        for batch in batches:
            vectors = VectorColumn(batch.column("embedding"))
            rows = np.flatnonzero(vectors.dims == wanted.shape[1])
            if not len(rows):
                continue
            sims = exact_cosine(vectors.block(rows), np.arange(len(rows)), query, np.zeros(len(rows), np.int64))
            at = pa.array(rows[sims > threshold])
            columns = [batch.column(c).take(at) for c in ("id", "role", "category")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sims[sims > threshold])], schema=schema)

    rows = entries.where("embedding is not null").select("id", *GROUP_KEYS, "embedding")
    found = rows.mapInArrow(score, "id bigint, role string, category string, similarity double")
    return _capped(found.orderBy(F.col("similarity").desc(), "id"), limit)


def topk_similarity(entries: DataFrame, queries: DataFrame, k: int, threshold: float = SEARCH_THRESHOLD,
                    *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best ``k`` semantic hits per query, all of them for k <= 0: query_id, rank, id, similarity."""
    hits = semantic_hits(entries, queries.withColumn("lim", F.lit(k)), threshold, block_rows=block_rows)
    best_first = [F.col("similarity").desc(), F.col("id")]
    if k > 0:
        return _rank_capped(hits, best_first).drop("lim")
    return ranked(materialize(hits, "semantic-hits"), "query_id", best_first, "topk-ranks").drop("lim")


def semantic_hits(
    entries: DataFrame, queries: DataFrame, threshold: float = SEARCH_THRESHOLD, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Hits above the threshold per query; a tile already drops what the query's limit cannot keep."""
    tagged = "tag" in queries.columns
    asking = queries.where("embedding is not null").select(
        *GROUP_KEYS, F.col("query_id").alias("id"), "embedding", F.expr(_NO_TAGS).alias("tags"),
        (F.col("tag") if tagged else F.lit(None)).cast("string").alias("tag"),
        (F.col("lim") if "lim" in queries.columns else F.lit(None)).cast("int").alias("lim"),
    )
    searched = only_groups_of(entries.where("embedding is not null"), asking, GROUP_KEYS).select(
        *GROUP_KEYS, "id", "embedding", (F.col("tags") if tagged else F.expr(_NO_TAGS)).alias("tags"),
        F.lit(None).cast("string").alias("tag"), F.lit(None).cast("int").alias("lim"),
    )
    return compare_sides(
        searched, asking, GROUP_KEYS, kernels.ranked_hits_kernel(list(GROUP_KEYS), threshold),
        f"{key_ddl(GROUP_KEYS)}, query_id bigint, id bigint, similarity double, lim int",
        lambda: cross_cell_tiles(searched, asking, plan_blocks([searched, asking], GROUP_KEYS, block_rows), threshold, block_rows),
    )


def keyword_hits(
    entries: DataFrame, queries: DataFrame, *, block_rows: int = BLOCK_ROWS, index: KeywordIndex | None = None
) -> DataFrame:
    """Keyword matches per query, through an index of trigrams: role, category, query_id, id, score, lim.

    ``index``: a stored one of the entries; what came later is searched without.
    """
    if index is not None:
        listed, later = (entries.where(side) for side in (F.col("id") <= index.last_id, F.col("id") > index.last_id))
        asking, searched = _keyword_sides(listed, queries)
        old = trigrams.matched_by_postings(searched, asking, block_rows=block_rows, lists=index.lists)
        return old.unionByName(keyword_hits(later, queries, block_rows=block_rows))
    asking, searched = _keyword_sides(entries, queries)
    volume = asking.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 64)).first()[0] or 0
    if volume <= blocks.BROADCAST_BYTES:
        return trigrams.matched_in_scan(searched, asking)
    return trigrams.matched_by_postings(searched, asking, block_rows=block_rows)


def _keyword_sides(entries: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries with keywords, and the entries of their groups."""
    tagged = "tag" in queries.columns
    asking = queries.select(
        *GROUP_KEYS, "query_id", X.keywords(F.col("query")).alias("words"),
        (F.col("tag") if tagged else F.lit(None)).cast("string").alias("tag"),
        (F.col("lim") if "lim" in queries.columns else F.lit(None)).cast("int").alias("lim"),
    ).where(F.size("words") > 0)
    searched = only_groups_of(entries, asking, GROUP_KEYS).select(
        *GROUP_KEYS, "id", F.col("tags") if tagged else F.expr(_NO_TAGS).alias("tags"), X.haystack(F.col("text"), F.col("tags")).alias("hay"))
    return asking, searched


def _rank_capped(hits: DataFrame, order: list) -> DataFrame:
    """Rank and cut queries that have a limit; a slice-wise cut first keeps one query off one task."""
    slices = F.pmod(F.xxhash64("id"), F.lit(_PRE_RANK_SLICES).cast("long"))
    part = Window.partitionBy("query_id", slices).orderBy(*order)
    final = Window.partitionBy("query_id").orderBy(*order)
    cut = hits.withColumn("_r", F.row_number().over(part)).where("_r <= lim").drop("_r")
    return cut.withColumn("rank", F.row_number().over(final)).where("rank <= lim")


def _rank(hits: DataFrame, order: list, label: str) -> DataFrame:
    limited = _rank_capped(hits.where("lim > 0"), order)
    open_ended = hits.where("lim is null or lim <= 0")
    if open_ended.isEmpty():
        return limited.drop("lim")
    return limited.unionByName(ranked(open_ended, "query_id", order, label)).drop("lim")


def batch_search(
    entries: DataFrame,
    queries: DataFrame,
    threshold: float = SEARCH_THRESHOLD,
    *,
    with_text: bool = False,
    block_rows: int = BLOCK_ROWS,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Hybrid search for a table of queries.

    ``queries``: query_id, role, category, query, embedding, and optionally tag and lim. A query
    with any semantic hit returns semantic hits only; one without (or without a vector) falls back
    to keywords over the same tag-filtered rows. Gives query_id, mode, rank, id and the similarity
    or the keyword score. ``index``: a stored index of the entries' keywords.
    """
    hits = materialize(semantic_hits(entries, queries, threshold, block_rows=block_rows), "semantic-hits")
    answered = hits.select("query_id").distinct()
    rest = materialize(queries.join(answered, "query_id", "left_anti"), "unanswered")
    words = materialize(keyword_hits(entries, rest, block_rows=block_rows, index=index), "keyword-hits")
    columns = [*GROUP_KEYS, "query_id", "id", "similarity", "score", "lim"]
    by_vector = hits.withColumn("score", F.lit(None).cast("int")).select(*columns)
    by_word = words.withColumn("similarity", F.lit(None).cast("double")).select(*columns)
    best_first = [F.col("similarity").desc(), F.col("id")]
    found = _rank(by_vector, best_first, "semantic-ranks").withColumn("mode", F.lit("semantic")).unionByName(
        _rank(by_word, [F.col("id")], "keyword-ranks").withColumn("mode", F.lit("keyword"))
    )
    if with_text:
        found = found.join(entries.select(*GROUP_KEYS, "id", "text"), [*GROUP_KEYS, "id"])
    return found


def hybrid_search(
    entries: DataFrame,
    role: str,
    category: str,
    query: str,
    vector: Sequence[float] | None = None,
    tag: str | None = None,
    limit: int | None = None,
    *,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """One query: semantic hits if there are any, else keyword hits over the same rows.

    Scans the group without a shuffle; gives id, mode, similarity or score, and text, best first.
    """
    rows = filter_tag(filter_role_category(entries, role, category), tag)
    if vector is not None:
        hits = materialize(semantic_search(rows, vector), "semantic-hits")
        if not hits.isEmpty():
            best = _capped(hits.orderBy(F.col("similarity").desc(), "id"), limit).join(rows.select("id", *GROUP_KEYS, "text"), ["id", *GROUP_KEYS])
            return best.select(
                "id", F.lit("semantic").alias("mode"), "similarity", F.lit(None).cast("int").alias("score"), "text"
            ).orderBy(F.col("similarity").desc(), "id")
    return keyword_search(rows, query, limit, index=index).select(
        "id", F.lit("keyword").alias("mode"), F.lit(None).cast("double").alias("similarity"), "score", "text"
    )


def search_report(entries: DataFrame, queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: entries searched (before any tag filter), matches returned and whether any was found."""
    searched = entries.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("s"))
    matched = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    return (
        queries.select("query_id", *GROUP_KEYS)
        .join(searched, list(GROUP_KEYS), "left")
        .join(matched, "query_id", "left")
        .select(
            "query_id", *GROUP_KEYS,
            F.coalesce("s", F.lit(0)).cast("bigint").alias("searched"),
            F.coalesce("m", F.lit(0)).cast("bigint").alias("matches"),
            F.coalesce(F.col("m") > 0, F.lit(False)).alias("found"),
        )
    )
