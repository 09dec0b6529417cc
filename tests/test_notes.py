"""The stored table as a whole: repairs that the queries do not reach."""

import os

import pytest
from pyspark.sql import functions as F

from notelake.functions.embed import embed_column, tried
from notelake.notes import NoteTable
from notelake.operators import blocks, filters, lines, search, similarity
from notelake.plans import merge
from notelake.session import scratch_path
from notelake.sources import exports, jsonl, keyword_index, memory_files, table

AS_OF = "2024-05-05"


@pytest.fixture
def refusing():
    """A provider that refuses batches with a bad text. Made here, so that it travels to the tasks by value."""

    def embed(texts):
        if any(t.startswith("bad") for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_bad_texts_in_front_cost_no_good_ones(spark, entries, refusing):
    texts = [f"bad {i}" for i in range(40)] + [f"good {i}" for i in range(960)]
    assert [v is None for v in tried(refusing, texts)] == [True] * 40 + [False] * 960
    rows = entries(list(enumerate(texts))).repartition(1).drop("embedding")
    got = embed_column(rows.orderBy("id"), refusing)
    assert got.where("embedding is not null").count() == 960
    assert got.where("embedding is null and text like 'good%'").count() == 0


def test_rebuild_reports_what_is_left(spark, tmp_path, entries, refusing):
    path = str(tmp_path / "t")
    table.append_entries(entries([(1, "bad one"), (2, "good"), (3, "bad two"), (4, "fine", [1.0, 1.0]), (5, "x", None, "other")]), path)
    report = {r["category"]: (r["pending"], r["filled"], r["remaining"]) for r in NoteTable(spark, path).rebuild(refusing).collect()}
    assert report == {"notes": (3, 1, 2), "other": (1, 1, 0)}


def test_store_dates_and_embeds(spark, tmp_path, entries, refusing):
    notes = NoteTable(spark, str(tmp_path / "t"))
    undated = entries([(1, "a"), (2, "bad"), (3, "a much longer one")]).drop("created_at", "embedding")
    with pytest.raises(ValueError):
        notes.store(undated)
    notes.store(undated, 0.999, embed=refusing, as_of=AS_OF)
    got = {r["text"]: (r["created_at"], r["embedding"]) for r in notes.entries().collect()}
    assert got == {"a": (AS_OF, [1.0, 1.0]), "bad": (AS_OF, None), "a much longer one": (AS_OF, [17.0, 1.0])}
    dated = entries([(1, "later")]).withColumn("created_at", F.when(F.lit(True), F.lit("2020-01-01")))
    notes.store(dated, as_of=AS_OF)
    assert notes.entries().where("text = 'later'").first()["created_at"] == "2020-01-01"


def test_search_embeds_the_query_or_falls_back(spark, tmp_path, entries, refusing):
    notes = NoteTable(spark, str(tmp_path / "t"))
    notes.store(entries([(1, "deploy the app", [5.0, 1.0]), (2, "something else", [-5.0, 1.0])]))
    assert [r["mode"] for r in notes.search("coder", "notes", "abcde", embed=refusing).collect()] == ["semantic"]
    assert [(r["mode"], r["text"]) for r in notes.search("coder", "notes", "bad deploy", embed=refusing).collect()] == [("keyword", "deploy the app")]


def test_missing_tags_count_as_none(spark):
    row = spark.createDataFrame([(1, "r", "c", "text", None, None, "2024-01-01")],
                                "id bigint, role string, category string, text string, embedding array<float>, tags array<string>, created_at string")
    assert '"tags":[]' in exports.export_json(row).first()["json"]
    assert [r["line"] for r in exports.export_markdown(row).where("kind = 2").collect()] == ["- **2024-01-01**: text"]
    assert search.keyword_search(row, "text").count() == 1 and filters.keyword_prefilter(row, "text").count() == 1


@pytest.mark.parametrize("spelled", ["{}", "file:{}", "file://{}", "{}/"])
def test_roots_in_any_spelling(spark, tmp_path, spelled):
    root = tmp_path / "tree"
    (root / "coder").mkdir(parents=True)
    (root / "coder" / "a.jsonl").write_text('{"text": "x"}\n')
    (row,) = jsonl.read_jsonl_memories(spark, spelled.format(root), AS_OF).collect()
    assert (row["path"], row["role"], row["category"]) == ("coder/a.jsonl", "coder", "a")


def test_written_trees_read_back_with_odd_names(spark, entries, tmp_path):
    root = str(tmp_path / "tree")
    names = ["a b", "x=1", "50%", "a+b", "c:d", "é日", "deep/role", "a.jsonl"]
    rows = [(i, f"text {i}", None, n) for i, n in enumerate(names * 30)]
    both = entries(rows, role="team/lead%").unionByName(entries([(999, "other")], role="01"))
    jsonl.write_jsonl_tree(both.repartition(7), root)
    got = jsonl.read_jsonl_memories(spark, root, AS_OF)
    assert sorted((r["role"], r["category"], r["text"]) for r in got.collect()) == sorted((r["role"], r["category"], r["text"]) for r in both.collect())
    files = jsonl.list_jsonl_files(spark, root)
    assert files.count() == len(names) + 1 and got.select("path").distinct().count() == len(names) + 1
    # The reading order of a file is the order in which it was written.
    ordered = got.where("category = 'x=1'").orderBy("path", "position").collect()
    assert [r["text"] for r in ordered] == [f"text {i}" for i, n in enumerate(names * 30) if n == "x=1"]


def test_a_group_over_several_files_is_imported_once(spark, tmp_path):
    root = tmp_path / "tree"
    for part, texts in enumerate((["one", "two"], ["two", "three"], ["three", "one", "four"])):
        folder = root / "coder" / "a.jsonl"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"part-{part:05d}").write_text("\n".join(f'{{"text": "{t}", "created_at": "2024-01-0{part + 1}"}}' for t in texts))
    notes = NoteTable(spark, str(tmp_path / "t"))
    total = notes.import_tree(str(root), as_of=AS_OF).where("level = 'total'").first()
    assert (total["files"], total["entries"], total["migrated"], total["skipped"]) == (1, 7, 4, 3)
    assert {r["text"]: r["created_at"] for r in notes.entries().collect()} == {"one": "2024-01-01", "two": "2024-01-01", "three": "2024-01-02", "four": "2024-01-03"}
    assert notes.import_tree(str(root), as_of=AS_OF).where("level = 'total'").first()["migrated"] == 0


def test_malformed_lines_do_not_enter_the_merge(spark, entries, tmp_path):
    root = str(tmp_path / "tree")
    good = jsonl.json_lines(entries([(1, "kept"), (2, "stored")])).select("role", "category", "value", "id")
    bad = good.limit(1).select("role", "category", F.explode(F.array(*[F.lit(x) for x in ("{", "  ", '{"tags": []}', "[1]")])).alias("value"), F.lit(5).cast("bigint").alias("id"))
    jsonl.write_lines_tree(good.unionByName(bad), root)
    records = jsonl.read_jsonl_memories(spark, root, AS_OF)
    assert [r["text"] for r in merge.merge_jsonl(records, entries([(9, "stored")])).collect()] == ["kept"]
    assert jsonl.quarantine(jsonl.read_jsonl_lines(spark, root, AS_OF)).count() == 3


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_signatures_find_the_same_at_any_size(entries, monkeypatch, limit):
    import random

    rnd = random.Random(3)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", limit)
    vectors = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, "t", [x + rnd.gauss(0, 0.01) for x in vectors[i % 60]]) for i in range(180)]
    incoming, stored = entries(rows[120:]), entries(rows[:120])
    exact = similarity.first_match(incoming, stored, 0.95).select("id", "match_id").collect()
    assert sorted(similarity.first_match(incoming, stored, 0.95, miss=1e-9).select("id", "match_id").collect()) == sorted(exact) and len(exact) >= 60


def test_only_the_groups_of_a_batch_are_read(spark, tmp_path, entries):
    path = str(tmp_path / "t")
    table.append_entries(entries([(1, "a", None, "one"), (2, "b", None, "two"), (3, "c", None, "three")]), path)
    held = similarity.anti_join_existing(entries([(9, "b", None, "two"), (10, "new", None, "two")]), table.scan_entries(spark, path))
    assert [r["id"] for r in held.collect()] == [10]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull" in plan


# Folders of note files ----------------------------------------------------------------------------


def _note(entries_in_session, more):
    return "# t\r\n## Session Log\n" + "".join(f"- [2024-01-01] s{i}\n" for i in range(entries_in_session)) + "\n## Notes\n" + "".join(f"- [x] n{i}\n" for i in range(more))


def test_a_fixed_folder_can_be_read_and_checked(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    files = {"long.md": _note(40, 60), "fine.md": _note(3, 2), "full.md": _note(20, 100), "empty.md": "", "odd name+%.md": _note(16, 1), "ignored.txt": "x"}
    for name, text in files.items():
        (folder / name).write_text(text)
    notes = NoteTable(spark, str(tmp_path / "t"))
    report = {r["name"]: r for r in notes.fix_folder(str(folder), target).collect()}
    after = {r["name"]: r for r in notes.check_folder(target).collect()}
    assert set(after) == set(report) == set(files) - {"ignored.txt"}
    for name, row in report.items():
        assert after[name]["line_count"] == (row["new_line_count"] if row["fixed"] else row["line_count"])
        assert after[name]["over_limit"] == row["over_limit"] and not after[name]["session_warn"]
    assert report["long.md"]["fixed"] and not report["fine.md"]["fixed"]
    read = memory_files.read_memory_files(spark, target)
    assert [r["line"] for r in read.where(F.col("path").endswith("/fine.md")).orderBy("line_no").collect()] == files["fine.md"].splitlines()
    again = {r["name"]: r for r in notes.fix_folder(target, str(tmp_path / "again")).collect()}
    assert not any(r["fixed"] for r in again.values())


def test_long_files_keep_their_line_numbers(spark):
    folder = scratch_path(spark, "long-notes")
    made = spark.range(5000).select(F.concat(F.lit("x/f"), F.col("id") % 3, F.lit(".md")).alias("path"), F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("line"))
    memory_files.write_memory_files(made.repartition(9), folder)
    got = memory_files.read_memory_files(spark, folder).orderBy("path", "line_no").collect()
    want = [(f"f{k}.md", n, f"line {i}") for k in range(3) for n, i in enumerate(range(k, 5000, 3))]
    assert [(os.path.basename(r["path"]), r["line_no"], r["line"]) for r in got] == want
    assert lines.check_files(memory_files.read_memory_files(spark, folder)).count() == 3


# Keyword index --------------------------------------------------------------------------------------


def test_an_index_covers_what_was_there_and_later_rows_are_searched(spark, tmp_path, entries):
    notes = NoteTable(spark, str(tmp_path / "t"))
    assert notes.keyword_index() is None
    notes.store(entries([(1, "deploy the database"), (2, "restart the server"), (3, "deploy everything", None, "other")]))
    notes.index_keywords()
    notes.store(entries([(1, "deploy the second database"), (2, "nothing")]))
    index = notes.keyword_index()
    every = notes.entries()
    for query in ("deploy database", "server", "the", "deploy nothing restart", "to a", "absent", "second database data base deploy the restart"):
        for limit in (None, 1):
            plain = [tuple(r) for r in search.keyword_search(every, query, limit).select("id", "category", "score").collect()]
            assert [tuple(r) for r in search.keyword_search(every, query, limit, index=index).select("id", "category", "score").collect()] == plain
        assert sorted(r["id"] for r in filters.keyword_prefilter(every, query, index=index).collect()) == sorted(r["id"] for r in filters.keyword_prefilter(every, query).collect())
    asked = spark.createDataFrame([(1, "coder", "notes", "deploy database"), (2, "coder", "other", "everything"), (3, "coder", "notes", "restart absent")],
                                  "query_id bigint, role string, category string, query string")
    plain = sorted(tuple(r) for r in search.keyword_hits(every, asked).collect())
    assert sorted(tuple(r) for r in search.keyword_hits(every, asked, index=index).collect()) == plain and len(plain) == 4
    assert [r["text"] for r in notes.search("coder", "notes", "second database").collect()] == ["deploy the database", "deploy the second database"]
    notes.index_keywords()
    assert notes.keyword_index().last_id > index.last_id


def test_few_candidates_reach_the_scan(spark, tmp_path, entries):
    path = str(tmp_path / "t")
    table.append_entries(entries([(i, f"common words {'needle' if i == 77 else 'hay'} {i}") for i in range(300)]), path)
    keyword_index.write_keyword_index(table.scan_entries(spark, path), f"{path}/_keywords")
    found = filters.keyword_prefilter(table.scan_entries(spark, path), "needle", index=keyword_index.read_keyword_index(spark, f"{path}/_keywords"))
    assert [r["id"] for r in found.collect()] == [77]
    assert "EqualTo(id,77)" in found._jdf.queryExecution().executedPlan().toString() or "In(id" in found._jdf.queryExecution().executedPlan().toString()
