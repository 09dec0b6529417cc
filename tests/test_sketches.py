import math

import numpy as np
import pyarrow as pa

from notelake.operators import sketches


def test_close_sketches_names_a_pair_once_and_keeps_groups_apart():
    n = 9
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3])
    table = pa.table({
        "role": ["a"] * 6 + ["b"] * 3, "id": pa.array(ids), "_dim": pa.array([4] * n, pa.int32()), "_band": pa.array([0] * 3 + [1] * 3 + [0] * 3, pa.int32()),
        "_sig": pa.array([7] * n), "_sketch": pa.array([bytes(32)] * n, pa.binary()),
        **{c: pa.array(np.zeros(n, np.int32)) for c in ("_b", "_i", "_j")}})
    out = sketches._close_sketches(["role"], ["role", "_dim", "_band", "_sig"], 3)(table).to_pylist()
    assert sorted((r["role"], r["id_a"], r["id_b"]) for r in out) == [(g, x, y) for g in "ab" for x, y in ((1, 2), (1, 3), (2, 3))]


def _tile(vectors, ids, bits, bands, block=None):
    """One tile with every band of these rows: of one block, or of the two that ``block`` deals them to."""
    batch = pa.record_batch({"role": ["r"] * len(ids), "id": pa.array(ids), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32()))})
    signed = pa.Table.from_batches(sketches._signed(["role"], bits, bands, 17)(iter([batch])))
    at = np.repeat(np.arange(len(ids)), bands)
    own = np.zeros(len(ids), np.int32) if block is None else block.astype(np.int32)
    zero = np.zeros(len(at), np.int32)
    columns = {"_row": pa.array(at), "_band": pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))), "_sig": signed["_sigs"].combine_chunks().flatten(),
               "_b": pa.array(own[at]), "_i": pa.array(zero), "_j": pa.array(zero if block is None else zero + 1)}
    tile = signed.take(pa.array(at))
    for name, column in columns.items():
        tile = tile.append_column(name, column)
    return tile


_BUCKET = ["role", "_dim", "_band", "_sig"]


def _pairs_of(tile, bits, allowed, threshold):
    live = sketches._close_sketches(["role"], _BUCKET, allowed, sketches.sketch_width(bits), tile.column_names)(tile)
    return live, list(sketches._met(["role"], _BUCKET, threshold, sketches.sketch_width(bits))(iter(live.to_batches())))


def test_a_tile_of_copies_answers_with_rows_and_its_pairs_come_in_portions():
    n = 2000
    tile = _tile(np.repeat(np.random.default_rng(1).standard_normal((1, 64)), n, axis=0).astype(np.float32), np.arange(n), 8, 3)
    live, portions = _pairs_of(tile, 8, 5, 0.92)
    # Rows of the first band alone: copies share all, and a pair is of the first.
    assert live.num_rows == n and set(live["_band"].to_pylist()) == {0}
    assert sum(p.num_rows for p in portions) == n * (n - 1) // 2
    assert max(p.num_rows for p in portions) <= sketches._BYTES // (8 * 64) and len(portions) > 100


def test_every_pair_of_a_shared_band_comes_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 60).tolist() + [150]
    centres = np.repeat(rng.standard_normal((len(sizes), 32)), sizes, axis=0)
    vectors = (centres + 0.15 * rng.standard_normal(centres.shape)).astype(np.float32)
    n = len(vectors)
    ids = rng.permutation(n)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for bits, bands in ((4, 6), (9, 11)):
        sigs = np.array(_tile(vectors, ids, bits, bands)["_sig"].to_pylist()).reshape(n, bands)
        for block in (None, rng.integers(0, 2, n)):
            shared = (sigs[:, None] == sigs[None]).any(axis=2) & (unit @ unit.T >= 0.95)
            if block is not None:
                shared &= block[:, None] != block[None]
            wanted = sorted((min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(*np.nonzero(np.triu(shared, 1))))
            tile = _tile(vectors, ids, bits, bands, block)
            _, portions = _pairs_of(tile, bits, bits * bands, 0.95)
            assert sorted((r["id_a"], r["id_b"]) for p in portions for r in p.to_pylist()) == wanted and len(wanted) > 1000
            # Named as pairs, the candidates hold them once each too.
            named = sketches._close_sketches(["role"], _BUCKET, bits * bands, sketches.sketch_width(bits))(tile)
            every = list(zip(named["id_a"].to_pylist(), named["id_b"].to_pylist()))
            assert len(every) == len(set(every)) and set(wanted) <= set(every)


def test_signs_that_may_differ_follow_the_binomial_tail():
    for signs, share in ((256, 0.128), (288, 0.128), (700, 0.2)):
        allowed = sketches.allowed_differences(share, 5e-7, signs)
        tails = [sum(math.comb(signs, k) * share**k * (1 - share) ** (signs - k) for k in range(n + 1, signs + 1)) for n in (allowed - 1, allowed)]
        assert tails[1] <= 5e-7 * 0.5 < tails[0]


def test_rows_without_a_group_or_id_and_ids_that_come_twice(spark):
    one, near, other = [1.0, 0.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [("a", 1, one), ("a", 2, near), ("a", 3, other), ("b", 2, one), (None, 1, one), (None, 2, one), ("a", None, one),
            ("a", 7, other), ("a", 7, other), ("b", 9, other), ("b", 9, one)]
    frame = spark.createDataFrame(rows, "role string, id bigint, embedding array<float>")
    found = sketches.sketched_pairs(frame, 0.92, 1e-6, ["role"]).collect()
    # An id that comes twice with like vectors has each of its rows with each; with others, it is two rows.
    assert sorted((r["role"], r["id_a"], r["id_b"]) for r in found) == [
        ("a", 1, 2), ("a", 3, 7), ("a", 3, 7), *[("a", 7, 7)] * 4, ("b", 2, 9)]
