"""Keyword search by trigrams against asking every entry for every keyword."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.functions import text as X
from notelake.operators import blocks, search, trigrams

SYLLABLES = ["an", "ber", "the", "ing", "é", "日本", "x", "tion", "o", "İ", "ss", "😀", "ab"]


def word(rnd, low=1, high=4):
    return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(low, high)))


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(11)
    common = "thething everywhere"
    rows = [(i, rnd.choice("ab"), rnd.choice("xyz"), " ".join([common, *[word(rnd) for _ in range(rnd.randint(0, 30))]]), rnd.choice([[], ["ops"], ["Ber", "日本x"], None]))
            for i in range(400)]
    rows += [(1000, "a", "x", "", []), (1001, "a", "x", "q" * 40, ["zz top"]), (1002, "b", "x", None, ["ops"])]
    asked = []
    for q in range(300):
        words = [word(rnd, 2, 4) for _ in range(rnd.randint(1, 7))] + rnd.choice([[], ["thething"], ["everywhere", "everywhere", "thething"]])
        rnd.shuffle(words)
        asked.append((q, rnd.choice("ab"), rnd.choice("xyzw"), rnd.choice([" ", "-", ", ", "_"]).join(words).upper(), rnd.choice([None, "", "ops", "Ber"]), rnd.choice([None, 0, 3])))
    asked += [(900, "a", "x", "to a", None, 1), (901, "a", "x", "qqq top", None, None), (902, "a", "x", None, None, None), (903, "a", "x", "qqqq qqqq zzz", "zz top", 5)]
    entries = spark.createDataFrame(rows, "id bigint, role string, category string, text string, tags array<string>").repartition(4).cache()
    return entries, spark.createDataFrame(asked, "query_id bigint, role string, category string, query string, tag string, lim int").repartition(3).cache()


def brute(entries, queries):
    e = entries.select("id", "role", "category", "tags", X.haystack(F.col("text"), F.col("tags")).alias("hay")).alias("e")
    q = queries.withColumn("words", X.keywords(F.col("query"))).alias("q")
    allowed = F.coalesce(F.col("q.tag"), F.lit("")).eqNullSafe("") | F.array_contains("e.tags", F.col("q.tag"))
    rows = e.join(q, ["role", "category"]).where(X.keyword_match(F.col("words"), F.col("hay")) & allowed)
    return rows.select("role", "category", "query_id", "id", X.keyword_hits(F.col("words"), F.col("hay")).alias("score"), "lim")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_forms_give_the_rows_of_the_product(tables, monkeypatch):
    entries, queries = tables
    want = rows(brute(entries, queries))
    assert len(want) > 500
    assert rows(search.keyword_hits(entries, queries)) == want
    for slice_rows, pairs in ((7, 5), (8192, 1)):
        monkeypatch.setattr(trigrams, "_SLICE_ROWS", slice_rows)
        monkeypatch.setattr(trigrams, "_PAIRS", pairs)
        assert rows(search.keyword_hits(entries, queries)) == want
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    assert rows(search.keyword_hits(entries, queries)) == want
    monkeypatch.setattr(trigrams, "MAX_SHIPPED_GRAMS", 10)
    assert rows(search.keyword_hits(entries, queries, block_rows=20)) == want


def test_untagged_queries(tables):
    entries, queries = tables
    plain = queries.drop("tag", "lim")
    want = rows(brute(entries, plain.withColumn("tag", F.lit(None).cast("string")).withColumn("lim", F.lit(None).cast("int"))))
    assert rows(search.keyword_hits(entries, plain)) == want


def test_nothing_asked_or_held(tables):
    entries, queries = tables
    assert search.keyword_hits(entries.limit(0), queries).count() == 0
    assert search.keyword_hits(entries, queries.limit(0)).count() == 0
    assert search.keyword_hits(entries, queries.where("query_id = 900")).count() == 0


@pytest.mark.parametrize("window", [4, 1 << 20])
def test_grams_are_all_of_a_text(monkeypatch, window):
    monkeypatch.setattr(trigrams, "_WINDOW", window)
    rnd = random.Random(2)
    texts = ["", "ab", "abc", "日本語日本語", "aaaaaaaaaaaa"] + ["".join(word(rnd) for _ in range(9)) for _ in range(30)]
    row, code = trigrams.grams_of(texts)
    code_of = lambda g: ord(g[0]) | ord(g[1]) << 21 | ord(g[2]) << 42
    want = sorted({(i, code_of(t[k:k + 3])) for i, t in enumerate(texts) for k in range(len(t) - 2)})
    assert sorted(zip(row.tolist(), code.tolist())) == want
    some = trigrams.Wanted(np.unique(code)[::3])
    row, number = trigrams.grams_of(texts, some)
    assert sorted(zip(row.tolist(), some.codes[number].tolist())) == [w for w in want if w[1] in set(some.codes.tolist())]


def test_posting_lists_are_bounded_and_whole(tables):
    entries, _ = tables
    hay = entries.select("role", "category", "id", X.haystack(F.col("text"), F.col("tags")).alias("hay")).where("hay is not null")
    lists = trigrams.postings(hay, block_rows=10).collect()
    found = sorted((r.role, r.category, r.gram, i) for r in lists for i in r.ids)
    texts = [(r.role, r.category, r.id, r.hay) for r in hay.collect()]
    assert len(found) == sum(len({t[k:k + 3] for k in range(len(t) - 2)}) for *_, t in texts) == len(set(found))
    assert max(len(r.ids) for r in lists) < 30
