"""Versions of a stored table under writers that meet or break off."""

import threading

import pytest
from pyspark.sql import functions as F

from notelake.notes import NoteTable
from notelake.plans import dedup
from notelake.sources import snapshots, table


def texts(notes):
    return sorted(r["text"] for r in notes.entries().collect())


@pytest.fixture
def notes(spark, tmp_path):
    return NoteTable(spark, str(tmp_path / "table"))


def test_a_write_that_breaks_off_leaves_the_old_version(spark, notes, entries):
    notes.store(entries([(1, "one", [1.0, 0.0]), (2, "copy", [1.0, 0.01])]))
    table.append_entries(entries([(50, "copy too", [1.0, 0.0]), (51, "else", [0.0, 1.0])]), notes.path)
    before, version = texts(notes), notes.snapshot().version
    boom = F.when(F.col("id") > 0, F.raise_error(F.lit("killed"))).otherwise(F.col("text"))
    broken = notes.entries().repartition(4).withColumn("text", boom.cast("string"))
    for write in (table.append_entries, table.replace_partitions):
        with pytest.raises(Exception):
            write(broken, notes.path)
        assert texts(notes) == before and notes.snapshot().version == version
    # What the broken writes left behind goes, what a version names stays.
    notes.vacuum(keep=9, unless_younger_than=0)
    assert texts(notes) == before


def test_clean_up_loses_nothing_that_is_stored_meanwhile(notes, entries, monkeypatch):
    table.append_entries(entries([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "x", [1.0, 0.0], "other")]), notes.path)
    plain, calls = dedup.dedup_find, []

    def meanwhile(rows, threshold):
        calls.append(1)
        if len(calls) == 1:
            notes.store(entries([(1, "c", [0.0, 1.0])]))
        return plain(rows, threshold)

    monkeypatch.setattr(dedup, "dedup_find", meanwhile)
    notes.collect_garbage("coder", dry_run=False)
    assert texts(notes) == ["a", "c", "x"] and len(calls) == 2


def test_writers_of_other_groups_do_not_disturb(notes, entries):
    table.append_entries(entries([(1, "a"), (2, "b", None, "other")]), notes.path)
    base = notes.snapshot()
    table.append_entries(entries([(3, "c", None, "other")]), notes.path)
    table.replace_partitions(entries([(1, "a new")]), notes.path, base=base)
    assert texts(notes) == ["a new", "b", "c"]
    with pytest.raises(snapshots.Conflict):
        table.replace_partitions(entries([(2, "lost", None, "other")]), notes.path, base=base)
    with pytest.raises(snapshots.Conflict):
        table.append_entries(entries([(9, "decided on old rows", None, "third")]), notes.path, base=base)
    assert texts(notes) == ["a new", "b", "c"]


def test_two_writers_at_once(spark, notes, entries):
    def store(k):
        notes.store(entries([(i, t) for i, t in enumerate(["shared", f"own {k}", f"more {k}"])]))

    notes.store(entries([(1, "first")]))
    threads = [threading.Thread(target=store, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert texts(notes) == sorted(["first", "shared", *[f"{w} {k}" for k in range(3) for w in ("own", "more")]])
    ids = [r["id"] for r in notes.entries().collect()]
    assert len(set(ids)) == len(ids)
    assert notes.snapshot().version == 4


def test_old_versions_stay_readable_until_they_go(notes, entries):
    table.append_entries(entries([(1, "a"), (2, "b", None, "x=1 %/é")]), notes.path)
    old = notes.snapshot()
    table.replace_partitions(entries([(1, "a2")]), notes.path)
    assert sorted(r["text"] for r in notes.entries(snapshot=old).collect()) == ["a", "b"]
    assert texts(notes) == ["a2", "b"]
    assert [r["text"] for r in notes.entries("coder", "x=1 %/é").collect()] == ["b"]
    assert notes.vacuum(keep=2, unless_younger_than=0) == []
    assert notes.vacuum(keep=1) == []
    assert len(notes.vacuum(keep=1, unless_younger_than=0)) == 1
    assert texts(notes) == ["a2", "b"]


def test_tables_written_without_versions_are_read_and_taken_on(spark, notes, entries):
    table.to_stored(entries([(1, "a"), (2, "b", None, "other")])).write.partitionBy("role", "category").parquet(notes.path)
    assert texts(notes) == ["a", "b"] and notes.snapshot().version == 0
    notes.store(entries([(1, "A "), (2, "c")]))
    assert texts(notes) == ["a", "b", "c"] and notes.snapshot().version == 1
    table.replace_partitions(entries([(1, "a2")]), notes.path)
    assert texts(notes) == ["a2", "b"]


def test_a_number_is_taken_once(spark, notes, entries):
    table.append_entries(entries([(1, "a")]), notes.path)
    taken = snapshots.Snapshot(1, ("x",))
    assert not snapshots._taken(spark, notes.path, taken)
    assert notes.snapshot().folders != ("x",)
