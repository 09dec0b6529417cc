import numpy as np
import pyarrow as pa

from notelake.operators import blocks, kernels


def _tile(vectors, ids, slots=None):
    n = len(vectors)
    zero = pa.array(np.zeros(n, np.int32))
    columns = {"role": ["r"] * n, "id": pa.array(ids), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "undecided": [True] * n, "_b": zero, "_i": zero, "_j": zero}
    return pa.table(columns | ({} if slots is None else {"_slot": pa.array(slots, pa.int32())}))


def test_small_blocks_share_a_tile(spark):
    rows = spark.range(2000).selectExpr("'r' as role", "id", "array(cast(id as float), 1f) as embedding")
    strip = blocks.blocks_per_tile(rows, 10)
    assert strip == blocks.TILE_ROWS // 10
    tiles = blocks.self_tiles(rows, blocks.plan_blocks([rows], ["role"], 10, strip))
    assert tiles.count() == 2000 and tiles.select("_slot").distinct().count() > 150
    # Strips of 50 blocks: four of them, and a row goes to one tile with each.
    assert blocks.self_tiles(rows, blocks.plan_blocks([rows], ["role"], 10, 50)).count() == 8000


def test_lists_of_every_slot_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.standard_normal((60, 64)), 12, axis=0) + 0.2 * rng.standard_normal((720, 64))
    vectors[7] = 0
    vectors = vectors.astype(np.float32)
    ids, slots = rng.permutation(720), rng.integers(0, 5, 720)
    found = kernels.older_neighbours_kernel(["role"], 0.95, False, 2)(_tile(vectors, ids, slots))
    unit = vectors.astype(float) / np.maximum(np.linalg.norm(vectors.astype(float), axis=1, keepdims=True), 1e-300)
    near = unit @ unit.T >= 0.95
    wanted = set()
    for i in range(720):
        for slot in range(5):
            older = sorted(int(ids[j]) for j in np.flatnonzero(near[i] & (slots == slot)) if ids[j] < ids[i])
            wanted |= {(int(ids[i]), o, slot, len(older) > 2) for o in older[:2]}
    assert {(r["id"], r["older_id"], r["slot"], r["more"]) for r in found.to_pylist()} == wanted and len(wanted) > 1000
