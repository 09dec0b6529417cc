import math

import pytest

from notelake.operators import blocks
from notelake.operators.similarity import anti_join_existing, similarity_join_lsh, similarity_self_join
from notelake.plans.admission import admit_batch, admitted_rows, rejected_rows


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def verdicts(df):
    return {r["id"]: (r["reason"], r["conflict_source"], r["conflict_id"], r["conflict_text"]) for r in df.collect()}


NEW = (None, None, None, None)


@pytest.mark.parametrize("block_rows, miss", [(8192, None), (3, None), (3, 1e-9)])
def test_order_and_mixed_rows(entries, monkeypatch, block_rows, miss):
    if block_rows == 3:
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    stored = entries([(1, "Stored vector", at(0)), (2, "bare", None)])
    incoming = entries(
        [
            (1, "near stored", at(5)),          # vector conflict with the table
            (2, " BARE\n", None),               # text conflict with the table
            (3, "bare", at(90)),                # a vector ignores text
            (4, "fresh", at(180)),
            (5, "fresh again", at(190)),        # conflict inside the batch
            (6, "FRESH ", None),                # text of an admitted vector row
            (7, "fresh again", None),           # its only equal was rejected
            (8, "Fresh Again", None),
            (9, " ", None),
            (10, "chain end", at(200)),         # near 5, which is out; 20 degrees from 4
        ]
    )
    got = verdicts(admit_batch(incoming, stored, math.cos(math.radians(15)), block_rows=block_rows, miss=miss))
    assert got == {
        1: ("duplicate", "stored", 1, "Stored vector"), 2: ("duplicate", "stored", 2, "bare"), 3: NEW, 4: NEW,
        5: ("duplicate", "batch", 4, "fresh"), 6: ("duplicate", "batch", 4, "fresh"), 7: NEW,
        8: ("duplicate", "batch", 7, "fresh again"), 9: ("text is required", None, None, None), 10: NEW,
    }


def test_threshold_is_strict_and_split_is_complete(entries):
    incoming = entries([(1, "a", [1.0, 0.0]), (2, "b", [0.6, 0.8])])
    edge = 0.6000000238418579 / math.sqrt(0.6000000238418579**2 + 0.800000011920929**2)
    verdict = admit_batch(incoming, incoming.limit(0), edge)
    assert admitted_rows(verdict).count() == 2 and rejected_rows(verdict).count() == 0


def test_existing_text_is_compared_as_is(entries):
    stored = entries([(1, "Same")])
    assert {r["id"] for r in anti_join_existing(entries([(5, "Same"), (6, "same"), (7, "Same ")]), stored).collect()} == {6, 7}


def test_pairs_with_and_without_tiles(spark, sf_dir):
    from notelake import fixtures as fx

    mixed = fx.mixed_copies(spark, sf_dir)
    whole = similarity_self_join(mixed).select("id_a", "id_b").collect()
    tiled = similarity_self_join(mixed, block_rows=64).select("id_a", "id_b").collect()
    assert sorted(whole) == sorted(tiled) and len(whole) > 3000


def test_lsh_finds_all_pairs_once(spark, sf_dir):
    from notelake import fixtures as fx

    rows = fx.vector_copies(spark, sf_dir)
    exact = sorted(similarity_self_join(rows).select("id_a", "id_b").collect())
    assert sorted(similarity_join_lsh(rows, block_rows=16).select("id_a", "id_b").collect()) == exact
