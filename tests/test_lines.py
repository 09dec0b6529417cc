import pytest

from notelake.operators import lines
from notelake.sources.memory_files import read_memory_files


def document(entries=5, filler=0):
    body = ["# Title", "", "## Mistakes", "- [2024-01-01] not counted", "## Session Log"]
    body += [f"- [2024-02-{i:02d}] session" for i in range(1, entries + 1)]
    return body + ["## Notes", "- [x] not counted"] + ["filler"] * filler


def table(spark, **files):
    rows = [(name, n, line) for name, body in files.items() for n, line in enumerate(body)]
    return spark.createDataFrame(rows, "path string, line_no int, line string")


def test_region_rules(spark):
    files = table(
        spark,
        plain=document(3),
        none=["# Title", "- [a]"],
        two=["## Session Log", "- [a]", "## Session Log again", "- [b]", "## Other", "- [c]", "## Session Log", "- [d]"],
        open_end=["## Session Log (2024)", "- [a]", "text", "### Sub", "- [b]"],
    )
    counts = {r["path"]: r["session_entries"] for r in lines.session_log_count(files).collect()}
    assert counts == {"plain": 3, "none": 0, "two": 2, "open_end": 2}
    docs = files.groupBy("path").agg({"line": "count"}).select("path")
    assert docs.count() == 4


def test_prune_keeps_the_first_and_is_stable(spark):
    files = table(spark, a=document(6), b=document(2))
    pruned = lines.prune_session_log(files, 3)
    left = [r["line"] for r in pruned.where("path = 'a'").orderBy("line_no").collect()]
    assert left == document(3)
    assert pruned.where("path = 'b'").count() == len(document(2))
    assert lines.prune_session_log(pruned, 3).count() == pruned.count()


@pytest.mark.parametrize(
    "entries, filler, fixed, new_count, over, warn",
    [
        (5, 0, False, None, False, False), (20, 0, True, 22, False, False), (20, 60, True, 80, False, False),
        (20, 200, True, 212, True, False), (10, 100, True, 112, True, False), (4, 100, False, None, True, False),
    ],
)
def test_fix(spark, entries, filler, fixed, new_count, over, warn):
    files = table(spark, a=document(entries, filler))
    row = lines.fix_files(files).first()
    assert (row["fixed"], row["new_line_count"], row["over_limit"], row["session_warn"]) == (fixed, new_count, over, warn)
    assert row["line_count"] == len(document(entries, filler)) and row["session_entries"] == entries
    assert lines.fixed_lines(files).count() == (new_count or row["line_count"])


def test_files_and_documents_agree(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("\r\n".join(document(20)).encode())
    (tmp_path / "b c.md").write_text("\n".join(document(2, 90)) + "\n")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "skip.txt").write_text("x\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.md").write_text("x\n")
    checked = {r["name"]: r for r in lines.check_files(read_memory_files(spark, str(tmp_path))).collect()}
    assert set(checked) == {"a.md", "b c.md", "empty.md"} and checked["empty.md"]["line_count"] == 0
    assert (checked["a.md"]["line_count"], checked["a.md"]["session_entries"], checked["a.md"]["status"]) == (27, 20, "PASS")
    assert checked["a.md"]["session_warn"] and checked["b c.md"]["status"] == "FAIL"
    texts = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.md").selectExpr(
        "element_at(split(_metadata.file_path, '/'), -1) as p", "value"
    )
    direct = {r["path"]: r for r in lines.check_documents(texts, "p", "value").collect()}
    assert (direct["a.md"]["line_count"], direct["a.md"]["session_entries"]) == (27, 20)


def test_report_of_an_empty_folder_passes(spark):
    row = lines.check_report(lines.check_files(table(spark, a=["x"]).limit(0))).first()
    assert (row["files"], row["any_fail"], row["any_warn"], row["passed"]) == (0, False, False, True)
