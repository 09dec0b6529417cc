"""Metric cells against comparing all vectors with all."""

import math

import numpy as np
import pytest

from notelake.operators import blocks, pivots, similarity
from notelake.plans.dedup import dedup_find
from notelake.session import materialize

THRESHOLD = 0.92


def clustered(seed, clusters, members, dim, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = np.repeat(centres, members, axis=0) + noise * rng.standard_normal((clusters * members, dim)) / math.sqrt(dim)
    return rows[rng.permutation(len(rows))].astype(np.float32)


def as_rows(vectors, categories=("notes",)):
    return [(i, f"t{i}", v.tolist(), categories[i % len(categories)]) for i, v in enumerate(vectors)]


def brute(rows, threshold=THRESHOLD):
    out = set()
    for category in {r[3] for r in rows}:
        mine = [r for r in rows if r[3] == category]
        for dim in {len(r[2]) for r in mine}:
            some = [r for r in mine if len(r[2]) == dim]
            values = np.array([r[2] for r in some], np.float32).astype(float)
            norms = np.linalg.norm(values, axis=1)
            unit = values / np.where(norms == 0, 1, norms)[:, None]
            a, b = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
            out |= {tuple(sorted((some[i][0], some[j][0]))) for i, j in zip(a.tolist(), b.tolist())}
    return out


def pairs(df):
    found = [(r["id_a"], r["id_b"]) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("worth", [0.5, 1e9], ids=["where cells prune", "always"])
@pytest.mark.parametrize("noise", [0.3, 3.0], ids=["clusters", "no structure"])
def test_self_join(entries, monkeypatch, worth, noise):
    monkeypatch.setattr(pivots, "WORTH", worth)
    rows = as_rows(clustered(1, 25, 24, 12, noise), ("one", "one", "two"))
    rows += [(9000 + i, "zero", [0.0] * 12, "one") for i in range(3)] + [(9100 + i, "short", [1.0, i / 50], "one") for i in range(60)]
    rows += [(9500 + i, "copy", rows[0][2], "one") for i in range(40)]
    want = brute(rows)
    assert pairs(similarity.vector_pairs(entries(rows).repartition(3), THRESHOLD, block_rows=30)) == want and len(want) > 1000


@pytest.mark.parametrize("worth", [0.5, 1e9])
def test_first_matches_of_a_batch(entries, monkeypatch, worth):
    monkeypatch.setattr(pivots, "WORTH", worth)
    rows = as_rows(clustered(2, 20, 25, 10, 0.3))
    incoming, stored = rows[300:], rows[:300]
    exact = similarity.cross_similarity_join(entries(incoming), entries(stored)).collect()
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    tiled = similarity.cross_similarity_join(entries(incoming), entries(stored), block_rows=25).collect()
    assert sorted(map(tuple, tiled)) == sorted(map(tuple, exact)) and len(exact) > 100


@pytest.mark.parametrize("local_edges", [2_000_000, 5])
def test_clean_up(entries, monkeypatch, local_edges):
    monkeypatch.setattr(pivots, "WORTH", 1e9)
    rows = as_rows(clustered(3, 12, 30, 8, 0.5), ("one", "two"))
    rows += [(5000 + i, rows[i][1].upper(), None, rows[i][3]) for i in range(0, 100, 3)]
    whole = dedup_find(entries(rows), 0.95, with_text=False).select("keep_id", "remove_id").collect()
    tiled = dedup_find(entries(rows), 0.95, with_text=False, block_rows=20, neighbours=2, local_edges=local_edges).select("keep_id", "remove_id").collect()
    assert sorted(map(tuple, tiled)) == sorted(map(tuple, whole)) and len(whole) > 50


def test_far_fewer_row_copies_than_the_grid_on_clusters(entries):
    rows = as_rows(clustered(4, 60, 100, 16, 0.2))
    table = materialize(entries(rows).select("role", "category", "id", "embedding"), "clustered")
    plan = blocks.plan_blocks([table], ("role", "category"), 100)
    grid = blocks.self_tiles(table, plan).count()
    cells = pivots.self_cell_tiles(table, plan, THRESHOLD, 100).count()
    assert grid >= 10 * cells, (grid, cells)


def test_vectors_without_structure_keep_the_grid(entries):
    rng = np.random.default_rng(5)
    rows = as_rows(rng.standard_normal((600, 64)).astype(np.float32))
    table = entries(rows).select("role", "category", "id", "embedding")
    assert pivots.plan_cells(table, ("role", "category"), 0.5, 50) is None
    assert pivots.plan_cells(table, ("role", "category"), -0.5, 50) is None
    assert pivots.plan_cells(table.limit(0), ("role", "category"), 0.9, 50) is None


def test_every_match_is_in_reach():
    vectors = clustered(6, 15, 20, 6, 0.6).astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    cells = pivots.Cells(pivots.spread_out(unit[:60], 20))
    angles = cells.angles(unit)
    home = angles.argmin(axis=1)
    cells.blocks = np.bincount(home, minlength=len(cells.pivots))
    cells.radius = np.array([angles[home == c, c].max(initial=0.0) for c in range(len(cells.pivots))])
    for threshold in (0.5, 0.92, 0.999, 1.0):
        reached = cells.reached(angles, math.acos(threshold))
        x, y = np.nonzero(unit @ unit.T >= threshold)
        assert reached[x, home[y]].all()
        assert (reached.sum() < reached.size) or threshold < 0.9
