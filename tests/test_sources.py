import json
import struct

import pytest
from pyspark.sql import functions as F

from notelake.notes import NoteTable
from notelake.operators import aggregates, ordering
from notelake.plans import merge
from notelake.sources import binary_vectors, exports, jsonl, table

AS_OF = "2024-05-05"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    files = {
        "coder/got chas+1%41.jsonl": [
            '{"text": "first", "tags": ["a", "b"], "created_at": "2024-01-01"}', "", "not json", "[1]",
            '{"tags": ["no text"]}', '{"text": "first"}', '{"text": "second", "tags": "scalar"}',
            '{"text": "trailing"} junk', "  ", "{'text': 'quotes'}", '{"text": null}',
        ],
        "team/lead/a.b.jsonl": ['{"text": "deep"}'],
        "team/empty.jsonl": [],
        "root.jsonl": ['{"text": "ignored"}'],
        "coder/notes.txt": ['{"text": "ignored"}'],
    }
    for name, lines in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines))
    return str(root)


def test_tolerant_reading(spark, tree):
    rows = jsonl.read_jsonl_memories(spark, tree, AS_OF).orderBy("path", "position").collect()
    assert [(r["role"], r["category"], r["text"], r["tags"], r["created_at"]) for r in rows] == [
        ("coder", "got chas+1%41", "first", ["a", "b"], "2024-01-01"), ("coder", "got chas+1%41", "first", [], AS_OF),
        ("coder", "got chas+1%41", "second", [], AS_OF), ("team/lead", "a.b", "deep", [], AS_OF),
    ]
    bad = jsonl.quarantine(jsonl.read_jsonl_lines(spark, tree, AS_OF))
    assert sorted(r["status"] for r in bad.collect()) == [
        "malformed", "malformed", "malformed", "malformed", "no_text", "no_text", "unplaced",
    ]


def test_import_is_idempotent(spark, tree, tmp_path):
    notes = NoteTable(spark, str(tmp_path / "table"))
    dry = {r["level"]: r for r in notes.import_tree(tree, as_of=AS_OF, dry_run=True).where("level = 'total'").collect()}
    assert (dry["total"]["entries"], dry["total"]["migrated"], notes.entries().count()) == (4, 0, 0)
    first = notes.import_tree(tree, as_of=AS_OF).where("level = 'total'").first()
    assert (first["files"], first["entries"], first["migrated"], first["skipped"], first["table_rows"]) == (4, 4, 3, 1, 3)
    again = notes.import_tree(tree, as_of=AS_OF).where("level = 'total'").first()
    assert (again["migrated"], again["skipped"], again["table_rows"]) == (0, 4, 3)
    kept = notes.entries("coder").orderBy("id").collect()
    assert [(r["text"], r["created_at"]) for r in kept] == [("first", "2024-01-01"), ("second", AS_OF)]


def test_rebuild_leaves_other_vectors_alone(spark, tmp_path, entries):
    path = str(tmp_path / "t")
    table.append_entries(entries([(1, "has", [1.0, 2.0]), (2, "none"), (3, "else", [3.0, 4.0], "other")]), path)
    notes = NoteTable(spark, path)
    assert [r["pending"] for r in notes.rebuild(dry_run=True).collect()] == [1]
    assert notes.entries().where("has_embedding").count() == 2
    notes.rebuild(lambda texts: [[float(len(t)), 0.0] for t in texts])
    got = {r["id"]: r["embedding"] for r in notes.entries().collect()}
    assert got == {1: [1.0, 2.0], 2: [4.0, 0.0], 3: [3.0, 4.0]}


def test_a_failing_embedder_leaves_nulls(entries):
    def broken(texts):
        raise RuntimeError("no provider")

    for embed in (broken, lambda texts: None, lambda texts: []):
        assert merge.rebuild_embeddings(entries([(1, "a"), (2, "b")]), embed).where("embedding is null").count() == 2


def test_store_search_and_garbage_collection(spark, tmp_path, entries):
    notes = NoteTable(spark, str(tmp_path / "t"))
    notes.store(entries([(1, "one", [1.0, 0.0]), (2, "ONE", [1.0, 0.01]), (3, "two", [0.0, 1.0])]))
    assert notes.count("coder", "notes") == 2
    notes.store(entries([(1, "two again", [0.01, 1.0]), (2, "bare")]))
    assert [r["text"] for r in notes.entries().orderBy("id").collect()] == ["one", "two", "bare"]
    table.append_entries(entries([(900, "copy", [1.0, 0.0]), (901, "x", None, "other")]), notes.path)
    assert notes.collect_garbage("coder").count() == 1 and notes.entries().count() == 5
    removed = notes.collect_garbage("coder", dry_run=False).collect()
    assert [(r["keep_text"], r["remove_text"]) for r in removed] == [("one", "copy")]
    assert sorted(r["text"] for r in notes.entries().collect()) == ["bare", "one", "two", "x"]
    assert [r["text"] for r in notes.search("coder", "notes", "zzz", [1.0, 0.0], limit=1).collect()] == ["one"]


def test_roles_that_look_like_numbers_and_paths_survive(spark, tmp_path, entries):
    path = str(tmp_path / "t")
    for role in ("01", "team/lead"):
        table.append_entries(entries([(1, "a")], role=role), path)
    assert {r["role"] for r in table.scan_entries(spark, path).collect()} == {"01", "team/lead"}
    plan = table.scan_entries(spark, path, "01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(role" in plan


def test_packed_vectors(spark):
    good, cut = struct.pack("<3f", 1.5, -2.0, 3.25), b"\x00\x01\x02"
    rows = spark.createDataFrame([(1, good), (2, cut), (3, None), (4, b"")], "id int, embedding binary")
    got = {r["id"]: (r["embedding"], r["broken"]) for r in binary_vectors.decode_embeddings(rows).collect()}
    assert got == {1: ([1.5, -2.0, 3.25], False), 2: (None, True), 3: (None, False), 4: ([], False)}
    back = binary_vectors.encode_embeddings(binary_vectors.decode_embeddings(rows).drop("broken")).collect()
    assert {r["id"]: r["embedding"] and bytes(r["embedding"]) for r in back}[1] == good


@pytest.fixture
def notes(spark):
    rows = [
        (3, "r", "b", "late", None, ["x", "y"], "2024-01-03"), (1, "r", "b", "early", [1.0], [], "2024-01-01"),
        (2, "r", "a", "other", [1.0], [], "2024-01-02"), (4, "s", "a", "else", None, [], "2024-01-03"),
    ]
    return spark.createDataFrame(
        rows, "id bigint, role string, category string, text string, embedding array<float>, tags array<string>, created_at string"
    )


def markdown(df):
    return "\n".join(r["line"] for r in df.orderBy(*exports.MARKDOWN_ORDER).collect())


def test_markdown(notes):
    assert markdown(exports.export_markdown(notes, "r")) == (
        "# r\n\n## a\n\n- **2024-01-02**: other\n## b\n\n- **2024-01-01**: early\n- **2024-01-03**: late `[x, y]`\n"
    )
    assert markdown(exports.export_markdown(notes, "nobody")) == "# nobody\n\nNo entries found.\n"
    assert "## a" not in markdown(exports.export_markdown(notes, "r", "b"))


def test_json(notes):
    rows = exports.export_json(notes, "r").orderBy("role", *ordering.EXPORT_ORDER).collect()
    assert [json.loads(r["json"])["id"] for r in rows] == [2, 1, 3]
    assert json.loads(rows[2]["json"]) == {
        "id": 3, "role": "r", "category": "b", "text": "late", "tags": ["x", "y"], "created_at": "2024-01-03"
    }


def test_timeline(notes):
    def ids(**kw):
        return [r["id"] for r in ordering.timeline(notes, "r", as_of="2024-01-03", **kw).collect()]

    assert ids() == [3, 2, 1] and ids(limit=1) == [3] and ids(limit=0) == [] and ids(limit=-1) == [3, 2, 1]
    assert ids(last="1d") == [3, 2] and ids(last="junk") == [3, 2, 1] and ids(category="a") == [2]


def test_statistics(notes):
    row = aggregates.stats_totals(notes, "r").first()
    assert (row["entries"], row["with_embeddings"], row["coverage_pct"]) == (3, 2, 66.7)
    assert (row["oldest_entry"], row["newest_entry"]) == ("2024-01-01", "2024-01-03")
    empty = aggregates.stats_totals(notes.limit(0)).first()
    assert (empty["entries"], empty["coverage_pct"], empty["oldest_entry"]) == (0, 0.0, None)
    health = {(r["role"], r["category"]): (r["pct"], r["status"]) for r in aggregates.embedding_health(notes).collect()}
    assert health == {("r", "a"): (100, "ok"), ("r", "b"): (50, "warn"), ("s", "a"): (0, "fail"), (None, None): (50, "fail")}
    assert aggregates.embedding_health(notes.limit(0)).count() == 0


def test_ranks_and_new_ids_follow_the_order(spark):
    rows = spark.range(1000).select(F.expr("id % 2").alias("g"), F.expr("1000 - id").alias("x"), F.lit("t").alias("text"))
    got = ordering.ranked(rows, "g", [F.col("x")]).orderBy("g", "x").collect()
    assert [r["rank"] for r in got] == [*range(1, 501), *range(1, 501)]
    ids = [r["id"] for r in ordering.with_next_ids(rows, ["x"], 41).orderBy("x").collect()]
    assert ids == sorted(set(ids)) and ids[0] == 42


def test_sinks_keep_the_order(spark, notes, tmp_path):
    exports.write_documents(exports.export_markdown(notes), str(tmp_path / "md"))
    parts = sorted((tmp_path / "md" / "role=r").glob("part-*"))
    assert "".join(p.read_text() for p in parts).rstrip("\n") == markdown(exports.export_markdown(notes, "r")).rstrip("\n")
    exports.write_json(notes, str(tmp_path / "json"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "json" / "role=r").glob("part-*"))).splitlines()
    assert [json.loads(line)["id"] for line in lines] == [2, 1, 3]
