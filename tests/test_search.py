import math

import pytest

from notelake.catalog import QUERIES
from notelake.operators import blocks, filters, search


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


@pytest.fixture
def notes(spark):
    rows = [
        (1, "r", "c", "deploy the app to staging", at(0), ["ops"], "2024-01-01"),
        (2, "r", "c", "deploy database", at(30), ["ops", "db"], "2024-01-02"),
        (3, "r", "c", "unrelated words", at(20), [], "2024-01-03"),
        (4, "r", "c", "deploy without vector", None, ["db"], "2024-01-04"),
        (5, "r", "other", "deploy elsewhere", at(0), ["ops"], "2024-01-05"),
    ]
    return spark.createDataFrame(
        rows, "id bigint, role string, category string, text string, embedding array<float>, tags array<string>, created_at string"
    )


def ids(df):
    return [r["id"] for r in df.collect()]


def test_semantic_order_and_limits(notes):
    found = search.hybrid_search(notes, "r", "c", "anything", at(0))
    assert ids(found) == [1, 3, 2] and {r["mode"] for r in found.collect()} == {"semantic"}
    assert ids(search.hybrid_search(notes, "r", "c", "anything", at(0), limit=2)) == [1, 3]
    assert ids(search.hybrid_search(notes, "r", "c", "anything", at(0), limit=0)) == [1, 3, 2]


def test_keyword_fallback_without_vector_or_hits(notes):
    for vector in (None, at(180)):
        found = search.hybrid_search(notes, "r", "c", "deploy database", vector)
        assert ids(found) == [1, 2, 4] and {r["mode"] for r in found.collect()} == {"keyword"}
        assert ids(search.hybrid_search(notes, "r", "c", "deploy database", vector, limit=1)) == [1]
    assert ids(search.hybrid_search(notes, "r", "c", "to a", None)) == []
    assert ids(search.hybrid_search(notes, "r", "none", "deploy", at(0))) == []


def test_tag_limits_both_modes(notes):
    assert ids(search.hybrid_search(notes, "r", "c", "x", at(0), tag="db")) == [2]
    assert ids(search.hybrid_search(notes, "r", "c", "deploy", at(180), tag="db")) == [2, 4]
    assert ids(search.hybrid_search(notes, "r", "c", "deploy", at(0), tag="DB")) == []


def test_keyword_threshold_is_half_rounded_up(notes):
    assert ids(search.keyword_search(notes, "deploy database nothing")) == [2]
    assert ids(search.keyword_search(notes, "nothing database")) == [2]
    assert ids(search.keyword_search(notes, "ops")) == [1, 2, 5]
    assert ids(search.keyword_search(notes, "deploy", 2)) == [1, 2]
    assert ids(search.keyword_search(notes, "to a")) == []


def test_prefilter(notes):
    assert sorted(ids(filters.keyword_prefilter(notes, "database staging"))) == [1, 2]
    assert filters.keyword_prefilter(notes, "to a").count() == 5
    assert filters.keyword_prefilter(notes, "nowhere").count() == 0


def test_large_groups_and_shuffled_queries_give_the_same(spark, sf_dir, monkeypatch):
    from notelake import fixtures as fx

    entries, asked = fx.vector_copies(spark, sf_dir), fx.query_batch(spark, sf_dir, 3)
    columns = ["query_id", "mode", "rank", "id"]
    whole = search.batch_search(entries, asked).select(*columns).collect()
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    tiled = search.batch_search(entries, asked, block_rows=100).select(*columns).collect()
    assert sorted(whole) == sorted(tiled) and len(whole) > 1000


def test_the_hybrid_query_asks_for_every_vector(spark, tmp_path):
    vectors = [(n, [float(n == k) for k in range(30)], 0) for n in range(9)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, "the data", "en", "src1")], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES["hybrid_search"](spark, str(tmp_path)).collect()
    batch = {(r["query_id"], r["mode"]) for r in found if r["query_no"] is None}
    assert batch == {(n, "semantic" if n % 3 == 0 else "keyword") for n in range(9)}
    assert {r["query_no"] for r in found} >= {None, 0, 1, 3}
