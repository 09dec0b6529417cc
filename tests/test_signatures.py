import math

from notelake.operators import similarity


def test_signatures_make_buckets_of_some_hundred_rows():
    bits, bands = similarity.lsh_parameters(0.92, 300_000, 1e-6)
    assert bands <= 60 and 300_000 / 2**bits > 100
    same = 1 - math.acos(0.92) / math.pi
    assert (1 - same**bits) ** bands <= 1e-6
