"""One query per operator, over the whole of the tables it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as X
from ..functions.embed import embed_column, hashed_words
from ..functions.vectors import cosine
from ..notes import NoteTable
from ..operators import aggregates, filters, lines, ordering, search, similarity, trigrams
from ..plans import dedup, merge
from ..plans.admission import admit_batch
from ..schema import GROUP_KEYS
from ..session import materialize, scratch_path
from ..sources import binary_vectors, exports, jsonl, memory_files, table
from ..sources import keyword_index as keyword_indexes
from ..streaming import admit as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _tags(column: str = "tags") -> Column:
    return F.array_join(column, ",").alias("tags")


def _vector_sum() -> Column:
    return F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("vector_sum")


def _dims() -> Column:
    return F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims")


_RECORD = ("id", "role", "category", "text", "created_at")


def _record(df: DataFrame) -> DataFrame:
    return df.select(*_RECORD, _tags(), _dims(), _vector_sum())


# --- sources and sinks ---------------------------------------------------------------------------


@query
def scan_entries(spark, sf):
    path = scratch_path(spark, "scan")
    table.append_entries(fx.documents_as_entries(spark, sf), path)
    return _record(table.scan_entries(spark, path))


@query
def append_entries(spark, sf):
    """Two appends to one table, read back as one."""
    path = scratch_path(spark, "append")
    entries = fx.documents_as_entries(spark, sf)
    table.append_entries(entries.where("embedding is null"), path)
    table.append_entries(entries.where("embedding is not null"), path)
    return table.scan_entries(spark, path).select("id", "role", "category", "text", "has_embedding", F.round("norm", 4).alias("norm"))


@query
def read_jsonl_memories(spark, sf):
    root = scratch_path(spark, "tree")
    jsonl.write_jsonl_tree(fx.documents_as_entries(spark, sf), root)
    return jsonl.read_jsonl_memories(spark, root, fx.AS_OF).select("role", "category", "text", "created_at", _tags())


def _note_folder(spark, sf):
    """The note files in one folder, where a name says what the path did."""
    folder = scratch_path(spark, "notes")
    memory_files.write_memory_files(fx.note_files(spark, sf).withColumn("path", F.replace("path", F.lit("/"), F.lit("-"))), folder)
    return folder


def _named(lines_table: DataFrame) -> DataFrame:
    return lines_table.select(F.element_at(F.split("path", "/"), -1).alias("name"), "line_no", "line")


@query
def read_memory_files(spark, sf):
    """Note files written to a folder and read back."""
    return _named(memory_files.read_memory_files(spark, _note_folder(spark, sf)))


@query
def fixed_folder(spark, sf):
    """A folder of note files pruned into a new one, read back and checked."""
    folder, target = _note_folder(spark, sf), scratch_path(spark, "fixed-notes")
    NoteTable(spark, scratch_path(spark, "none")).fix_folder(folder, target)
    checked = lines.check_files(memory_files.read_memory_files(spark, target))
    return checked.select("name", "line_count", "session_entries", "over_limit", "session_warn")


@query
def export_json(spark, sf):
    return exports.export_json(fx.documents_as_entries(spark, sf)).select("id", "role", "category", "json")


@query
def export_markdown(spark, sf):
    return exports.export_markdown(fx.documents_as_entries(spark, sf))


@query
def decode_embeddings(spark, sf):
    packed = binary_vectors.encode_embeddings(fx.table(spark, sf, "embeddings"))
    unpacked = binary_vectors.decode_embeddings(packed)
    return unpacked.select("vec_id", "broken", _dims(), _vector_sum())


# --- projections and filters ---------------------------------------------------------------------


@query
def filter_role_category(spark, sf):
    return filters.filter_role_category(fx.documents_as_entries(spark, sf), "en", "src1").select(*_RECORD)


@query
def filter_tag(spark, sf):
    return filters.filter_tag(fx.documents_as_entries(spark, sf), "quality").select(*_RECORD, _tags())


@query
def filter_since(spark, sf):
    return filters.filter_since(fx.events_as_entries(spark, sf), "7d", fx.EVENTS_AS_OF).select(*_RECORD)


def _entries_with_gaps(spark, sf):
    blank = "case when lang = '{0}' and source in ('src1', 'src2') then {1} else {2} end as {3}"
    return fx.table(spark, sf, "documents").selectExpr(
        "doc_id as id", blank.format("de", "'  '", "lang", "role"), blank.format("fr", "null", "source", "category"),
        blank.format("es", "concat(chr(9), ' ', decode(unhex('C2A0'), 'UTF-8'), chr(10))", "text", "text"),
    )


@query
def validate_entries(spark, sf):
    return filters.validate_entries(_entries_with_gaps(spark, sf)).select("id", "reject_reason")


@query
def parse_tags(spark, sf):
    raw = fx.table(spark, sf, "labels").selectExpr(
        "doc_id",
        """case when quality = 1 and toxic = 1 then '["a", "b"]' when quality = 1 then '["a"]'
                when toxic = 1 then 'not json' when doc_id % 3 = 0 then null when doc_id % 3 = 1 then ''
                else '{"a": 1}' end as tags""",
    )
    return filters.parse_tags(raw).select("doc_id", _tags(), F.size("tags").alias("n_tags"))


@query
def tokenize_query(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"))
    return filters.tokenize_query(docs).select(
        "doc_id", F.size("keywords").alias("n_keywords"), F.array_join("keywords", "|").alias("keywords")
    )


@query
def keyword_prefilter(spark, sf):
    return filters.keyword_prefilter(fx.documents_as_entries(spark, sf), "toxic data-base, ein").select("id", "role")


@query
def pending_embeddings(spark, sf):
    return filters.pending_embeddings(fx.documents_as_entries(spark, sf)).select("id", "role", "category")


# --- search --------------------------------------------------------------------------------------

_WORDS = "quality the system, data and model-results"


@query
def keyword_search(spark, sf):
    return search.keyword_search(fx.documents_as_entries(spark, sf), _WORDS).select("id", "role", "category", "score")


@query
def semantic_search(spark, sf):
    vector = fx.table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]
    found = search.semantic_search(fx.vector_copies(spark, sf), vector, threshold=0.3)
    return found.withColumn("similarity", F.round("similarity", 4))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "mode", "rank", "id", F.round("similarity", 4).alias("similarity"), "score")


@query
def hybrid_search(spark, sf):
    """Every query of the batch, without ranks cut off; then single ones: one that vectors answer, one that falls back to
    keywords, one without a vector but with a tag, one cut off."""
    copies, docs = fx.vector_copies(spark, sf), fx.documents_as_entries(spark, sf)
    given = fx.table(spark, sf, "embeddings").where("vec_id in (3, 4)").orderBy("vec_id").collect()
    asked = [
        search.hybrid_search(copies, "vec", f"c{given[0]['label']}", "vector item", given[0]["embedding"]),
        search.hybrid_search(copies, "vec", f"c{given[1]['label']}", "item 00004", [-x for x in given[1]["embedding"]]),
        search.hybrid_search(docs, "en", "src1", _WORDS, tag="quality"),
        search.hybrid_search(copies, "vec", f"c{given[0]['label']}", "vector item", limit=7),
    ]
    columns = ["query_no", "query_id", "mode", "rank", "id", "similarity", "score", "text"]
    batch = _hits(search.batch_search(copies, fx.query_batch(spark, sf, None)))
    found = batch.select(F.lit(None).cast("int").alias("query_no"), "*", F.lit(None).cast("string").alias("text")).select(*columns)
    for number, one in enumerate(asked):
        here = one.withColumns({"query_no": F.lit(number), "query_id": F.lit(None).cast("bigint"), "rank": F.lit(None).cast("int")})
        found = found.unionByName(here.withColumn("similarity", F.round("similarity", 4)).select(*columns))
    return found


@query
def batch_search_unlimited(spark, sf):
    return _hits(search.batch_search(fx.vector_copies(spark, sf), fx.query_batch(spark, sf, None)))


@query
def batch_search(spark, sf):
    return _hits(search.batch_search(fx.vector_copies(spark, sf), fx.query_batch(spark, sf, 3)))


@query
def topk_similarity(spark, sf):
    found = search.topk_similarity(fx.vector_copies(spark, sf), fx.query_batch(spark, sf), 4, threshold=0.2)
    return found.select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity"))


@query
def tagged_search(spark, sf):
    """Every benchmark passage as a keyword query to every (role, category) of the tagged documents."""
    entries = fx.documents_as_entries(spark, sf)
    groups = [(r["role"], r["category"]) for r in entries.select(*GROUP_KEYS).distinct().collect()]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("category")) for a, b in groups]))
    asked = fx.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"), each.alias("g")).selectExpr(
        "item_id * 10000 + cast(substring(g.category, 4) as int) * 100 + instr('de en es fr', g.role) as query_id", "g.role", "g.category", "query",
        "cast(null as array<float>) as embedding", "case when item_id % 2 = 0 then 'quality' end as tag", "5 as lim",
    )
    return search.batch_search(entries, asked).select("query_id", "mode", "rank", "id", "score")


def _indexed_entries(spark, sf):
    """A stored table of all documents, and an index that was made before those with a vector came."""
    path = scratch_path(spark, "indexed")
    entries = fx.documents_as_entries(spark, sf)
    first = entries.agg(F.expr("cast(percentile_approx(id, 0.7) as bigint)").alias("id")).first()["id"]
    table.append_entries(entries.where(F.col("id") <= first), path)
    keyword_indexes.write_keyword_index(table.scan_entries(spark, path), f"{path}/_keywords")
    table.append_entries(entries.where(F.col("id") > first), path)
    return table.scan_entries(spark, path), keyword_indexes.read_keyword_index(spark, f"{path}/_keywords")


@query
def keyword_index(spark, sf):
    """In how many entries of each group each trigram is."""
    hay = fx.documents_as_entries(spark, sf).select(*GROUP_KEYS, "id", X.haystack(F.col("text"), F.col("tags")).alias("hay"))
    return trigrams.postings(hay).groupBy(*GROUP_KEYS, "gram").agg(F.sum(F.size("ids")).alias("n"))


@query
def keyword_search_indexed(spark, sf):
    entries, index = _indexed_entries(spark, sf)
    return search.keyword_search(entries, _WORDS, index=index).select("id", "role", "category", "score")


@query
def keyword_prefilter_indexed(spark, sf):
    entries, index = _indexed_entries(spark, sf)
    return filters.keyword_prefilter(entries, "toxic data-base, ein", index=index).select("id", "role")


@query
def search_report(spark, sf):
    entries, asked = fx.vector_copies(spark, sf), fx.query_batch(spark, sf, 3)
    return search.search_report(entries, asked, search.batch_search(entries, asked))


# --- joins ---------------------------------------------------------------------------------------


def _pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 4))


@query
def similarity_self_join(spark, sf):
    return _pairs(similarity.similarity_self_join(fx.mixed_copies(spark, sf)))


@query
def similarity_join_lsh(spark, sf):
    return _pairs(similarity.similarity_join_lsh(fx.vector_copies(spark, sf)))


@query
def cross_similarity_join(spark, sf):
    entries = fx.vector_copies(spark, sf)
    return _pairs(similarity.cross_similarity_join(entries.where("copy_no > 0"), entries.where("copy_no = 0")))


@query
def anti_join_existing(spark, sf):
    entries = fx.documents_as_corpus(spark, sf)
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return similarity.anti_join_existing(
        entries.join(labelled, "id", "left_anti"), entries.join(labelled, "id", "left_semi")
    ).select("id", "category")


# --- de-duplication and maintenance --------------------------------------------------------------


@query
def dedup_find(spark, sf):
    return dedup.dedup_find(fx.vector_copies(spark, sf))


@query
def dedup_find_mixed(spark, sf):
    return dedup.dedup_find(fx.mixed_copies(spark, sf))


@query
def dedup_find_tiled(spark, sf):
    """The path of groups too large for one tile, reached here by small tiles."""
    return dedup.dedup_find(fx.mixed_copies(spark, sf), with_text=False, block_rows=48)


@query
def dedup_find_lsh(spark, sf):
    return dedup.dedup_find(fx.vector_copies(spark, sf), with_text=False, block_rows=48, miss=1e-6)


@query
def dedup_summary(spark, sf):
    entries = fx.vector_copies(spark, sf)
    return dedup.dedup_summary(entries, dedup.dedup_find(entries, with_text=False))


@query
def dedup_apply(spark, sf):
    entries = fx.vector_copies(spark, sf)
    return dedup.dedup_apply(entries, dedup.dedup_find(entries, with_text=False)).select("id", "category", "text")


@query
def dedup_exact_text(spark, sf):
    return dedup.dedup_exact_text(fx.documents_as_corpus(spark, sf), with_text=True)


@query
def admit_batch_mixed(spark, sf):
    entries = fx.mixed_copies(spark, sf)
    return admit_batch(entries.where("copy_no > 0"), entries.where("copy_no = 0")).select(
        "id", "category", "admitted", "reason", "conflict_source", "conflict_id", "conflict_text"
    )


QUERIES["admit_batch"] = QUERIES.pop("admit_batch_mixed")


def _corpus_tree(spark, sf):
    """Documents as a tree of JSON lines, with lines in between that are no records, and what of them is stored already."""
    root = scratch_path(spark, "corpus")
    entries = fx.documents_as_corpus(spark, sf)
    # After every seventh document a line that is cut off, blank, without text, no object, or two at once.
    bad = F.array(*[F.lit(x) for x in ('{"text": "cut off', "  ", '{"tags": ["a"]}', '["text"]', '{"text": "two"} {"text": "values"}')])
    junk = entries.where("id % 7 = 0").select(*GROUP_KEYS, F.element_at(bad, (F.col("id") % 5 + 1).cast("int")).alias("value"), "id")
    jsonl.write_lines_tree(jsonl.json_lines(entries).select(*GROUP_KEYS, "value", "id").unionByName(junk), root)
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return root, entries.join(labelled, "id", "left_semi")


@query
def merge_jsonl(spark, sf):
    root, stored = _corpus_tree(spark, sf)
    added = merge.merge_jsonl(jsonl.read_jsonl_memories(spark, root, fx.AS_OF), stored)
    return added.select("role", "category", "text", "created_at", _tags())


@query
def merge_summary(spark, sf):
    root, stored = _corpus_tree(spark, sf)
    records = jsonl.read_jsonl_memories(spark, root, fx.AS_OF)
    added = materialize(merge.merge_jsonl(records, stored), "added")
    return merge.merge_summary(records, added, jsonl.list_jsonl_files(spark, root), stored)


@query
def rebuild_embeddings(spark, sf):
    entries = fx.documents_as_entries(spark, sf).withColumn("had", F.col("embedding").isNotNull())
    rebuilt = merge.rebuild_embeddings(entries, hashed_words())
    return rebuilt.select(
        "id", "had", F.col("embedding").isNotNull().alias("has"), _dims(),
        F.when(F.col("had"), _vector_sum()).alias("vector_sum"),
    )


# --- aggregates ----------------------------------------------------------------------------------


@query
def count_entries(spark, sf):
    return aggregates.count_entries(fx.documents_as_entries(spark, sf))


@query
def list_categories(spark, sf):
    return aggregates.list_categories(fx.documents_as_entries(spark, sf))


@query
def list_roles(spark, sf):
    return aggregates.list_roles(fx.documents_as_entries(spark, sf))


@query
def stats_totals(spark, sf):
    return aggregates.stats_totals(fx.documents_as_entries(spark, sf))


@query
def stats_by_category(spark, sf):
    return aggregates.stats_by_category(fx.documents_as_entries(spark, sf))


@query
def stats_rollup(spark, sf):
    return aggregates.stats_rollup(fx.documents_as_entries(spark, sf))


@query
def embedding_health(spark, sf):
    return aggregates.embedding_health(fx.documents_as_entries(spark, sf))


@query
def storage_size(spark, sf):
    """Bytes of a text table: every text and its line end."""
    path = scratch_path(spark, "size")
    fx.table(spark, sf, "documents").select("text").write.text(path)
    return aggregates.storage_size(spark.read.text(path)).select("bytes")


# --- ordered lines -------------------------------------------------------------------------------


@query
def session_log_region(spark, sf):
    return lines.session_log_region(fx.note_files(spark, sf))


@query
def session_log_count(spark, sf):
    return lines.session_log_count(fx.note_files(spark, sf))


@query
def prune_session_log(spark, sf):
    return lines.prune_session_log(fx.note_files(spark, sf), 10)


@query
def check_files(spark, sf):
    return lines.check_files(fx.note_files(spark, sf))


@query
def check_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return lines.check_documents(docs, "doc", "text")


@query
def fix_files(spark, sf):
    return lines.fix_files(fx.note_files(spark, sf))


@query
def fixed_lines(spark, sf):
    return lines.fixed_lines(fx.note_files(spark, sf))


@query
def check_report(spark, sf):
    return lines.check_report(lines.check_files(fx.note_files(spark, sf)))


@query
def first_wins(spark, sf):
    entries = fx.documents_as_corpus(spark, sf).select("role", "category", X.text_key(F.col("text")).alias("h"), "id", "created_at")
    return ordering.first_wins(entries, [*GROUP_KEYS, "h"], ["id"]).drop("h")


# --- orders and top-k ----------------------------------------------------------------------------


@query
def timeline(spark, sf):
    return ordering.timeline(fx.events_as_entries(spark, sf), "click", "7d", as_of=fx.EVENTS_AS_OF).select(*_RECORD)


@query
def timeline_all_roles(spark, sf):
    return ordering.timeline_all_roles(fx.events_as_entries(spark, sf), None, 20, as_of=fx.EVENTS_AS_OF).select(
        *_RECORD, "rank"
    )


@query
def export_order(spark, sf):
    return ordering.export_order(fx.documents_as_entries(spark, sf)).select("role", "category", "created_at", "id")


# --- expressions ---------------------------------------------------------------------------------


@query
def text_expressions(spark, sf):
    e = fx.documents_as_entries(spark, sf)
    return e.select(
        "id", X.normalized(F.col("text")).alias("normalized"), X.haystack(F.col("text"), F.col("tags")).alias("haystack"),
        X.preview(F.col("text")).alias("preview"),
    )


@query
def cosine_expression(spark, sf):
    e = fx.vector_copies(spark, sf)
    base = e.where("copy_no = 0").select("vec_id", F.col("embedding").alias("base"))
    sims = e.join(base, "vec_id").select("id", cosine(F.col("embedding"), F.col("base")).alias("s"))
    return sims.select("id", F.round("s", 4).alias("similarity"))


@query
def embed_documents(spark, sf):
    e = embed_column(fx.table(spark, sf, "documents").select("doc_id", "text"), hashed_words())
    return e.select("doc_id", F.col("embedding").isNotNull().alias("has"), _dims())


QUERIES["embed_column"] = QUERIES.pop("embed_documents")


# --- streaming -----------------------------------------------------------------------------------


def _stream(spark, sf, name):
    # A pattern, since a table is one file or a folder of them, and a plain path would have to be a folder.
    return spark.readStream.schema(fx.table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")


@query
def stream_admit(spark, sf):
    sink, state = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-state")
    arriving = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("corpus").alias("role"), F.col("lang").alias("category"), "text"
    )
    streaming.stream_admit(arriving, sink, state).awaitTermination()
    # With the schema at hand, since nothing may have been admitted.
    return spark.read.schema(arriving.schema).parquet(sink).select("role", "category", X.normalized(F.col("text")).alias("normalized"))


@query
def stream_admit_semantic(spark, sf):
    sink, state = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-state")
    arriving = fx.vector_copies_of(_stream(spark, sf, "embeddings"))
    streaming.stream_admit_semantic(arriving, sink, state).awaitTermination()
    return streaming.read_admitted(spark, sink, arriving.schema).select("id", "category")
