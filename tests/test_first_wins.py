"""Greedy resolution against a plain sequential walk, on every physical path."""

import math
import random

import numpy as np
import pytest

from notelake.plans.dedup import dedup_apply, dedup_find
from notelake.plans.first_wins import resolve_first_wins

PATHS = {
    "one tile per group": {},
    "tiles": {"block_rows": 16},
    "tiles, short lists": {"block_rows": 16, "neighbours": 1},
    "tiles, rounds": {"block_rows": 16, "local_edges": 5},
    "tiles, short lists, rounds": {"block_rows": 8, "neighbours": 1, "local_edges": 3},
}


def cosine(a, b):
    a, b = np.float32(a).astype(float), np.float32(b).astype(float)
    scale = math.sqrt(float(a @ a)) * math.sqrt(float(b @ b))
    return 0.0 if scale == 0 else float(a @ b) / scale


def matches(a, b, threshold, strict):
    if a[2] is not None and b[2] is not None:
        if len(a[2]) != len(b[2]):
            return False
        sim = cosine(a[2], b[2])
    else:
        sim = 1.0 if a[1].strip().lower() == b[1].strip().lower() else 0.0
    return sim > threshold if strict else sim >= threshold


def walk(rows, threshold, strict=False):
    removed = {}
    groups = {}
    for row in sorted(rows):
        groups.setdefault(row[3] if len(row) > 3 else None, []).append(row)
    for group in groups.values():
        for i, a in enumerate(group):
            if a[0] in removed:
                continue
            for b in group[i + 1:]:
                if b[0] not in removed and matches(a, b, threshold, strict):
                    removed[b[0]] = a[0]
    return removed


def found(df):
    return {r["remove_id"]: r["keep_id"] for r in df.collect()}


def on_circle(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def random_rows(seed, n=70, bare=0.2, copies=0.3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = f" Text {rng.randrange(12)}" + rng.choice(["", "\n", "  "])
        vector = on_circle(rng.uniform(0, 360))
        if rows and rng.random() < copies:
            vector = rng.choice(rows)[2]
        elif rng.random() < bare:
            vector = None
        elif rng.random() < 0.05:
            vector = [0.0, 0.0]
        rows.append((i * 3 + 1, text, vector, rng.choice(["a", "a", "a", "b"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("path, seed", [(p, n % 2 + 1) for n, p in enumerate(PATHS)], ids=str)
def test_matches_sequential_walk(entries, path, seed):
    rows = random_rows(seed)
    got = found(dedup_find(entries(rows), 0.99, with_text=False, **PATHS[path]))
    assert got == walk(rows, 0.99)


@pytest.mark.parametrize("path", ["one tile per group", "tiles", "tiles, short lists, rounds"], ids=str)
def test_long_chain_alternates(entries, path):
    # Only neighbours match, so every second row goes.
    rows = [(i, f"t{i}", on_circle(i * 10)) for i in range(20)]
    got = found(dedup_find(entries(rows), math.cos(math.radians(12)), with_text=False, **PATHS[path]))
    assert got == {i: i - 1 for i in range(1, 20, 2)}


@pytest.mark.parametrize("path", ["one tile per group", "tiles", "tiles, short lists, rounds"], ids=str)
def test_one_dense_cluster(entries, path):
    rows = [(i, f"t{i}", on_circle(i * 0.01)) for i in range(60)] + [(99, "far", on_circle(90))]
    got = found(dedup_find(entries(rows), 0.92, with_text=False, **PATHS[path]))
    assert got == {i: 0 for i in range(1, 60)}


def test_a_third_of_the_rows_are_one_copy(entries):
    rows = [(i, f"t{i}", [1.0, 0.0] if i % 3 == 0 else on_circle(20 + i)) for i in range(120)]
    got = found(dedup_find(entries(rows), 0.9999, with_text=False, block_rows=16))
    assert got == walk(rows, 0.9999)


def test_strict_threshold_excludes_equality(entries):
    import pyspark.sql.functions as F

    rows = entries([(1, "a", [1.0, 0.0]), (2, "b", [0.6, 0.8]), (3, "c", [1.0, 0.0])])
    rows = rows.withColumn("_h", F.lit(None).cast("string"))
    edge = cosine([1.0, 0.0], [0.6, 0.8])
    assert found(resolve_first_wins(rows, edge)) == {2: 1, 3: 1}
    assert found(resolve_first_wins(rows, edge, strict=True)) == {3: 1}


def test_zero_vector_matches_nothing_and_lengths_do_not_mix(entries):
    rows = [(1, "a", [0.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "c", [1.0, 0.0]), (4, "d", [1.0, 0.0, 0.0])]
    assert found(dedup_find(entries(rows), 0.5, with_text=False)) == {}


def test_rejects_non_positive_threshold(entries):
    with pytest.raises(ValueError):
        dedup_find(entries([(1, "a")]), 0.0)


def test_categories_are_kept_apart_and_texts_reported(entries):
    rows = [(1, "same", None, "x"), (2, " SAME\n", None, "x"), (3, "same", None, "y")]
    result = dedup_find(entries(rows)).collect()
    assert [(r["keep_text"], r["remove_text"], r["similarity"], r["category"]) for r in result] == [
        ("same", " SAME\n", 1.0, "x")
    ]


def test_survivors_hold_no_duplicates(entries):
    table = entries(random_rows(5))
    left = dedup_apply(table, dedup_find(table, 0.99, with_text=False))
    assert dedup_find(left, 0.99, with_text=False).count() == 0


def test_signature_buckets_agree_with_the_exact_answer(spark, sf_dir):
    from notelake import fixtures as fx

    mixed = fx.mixed_copies(spark, sf_dir)
    exact = found(dedup_find(mixed, with_text=False))
    assert found(dedup_find(mixed, with_text=False, block_rows=32, miss=1e-6)) == exact and len(exact) > 1000
