"""Similarity join by signatures: vectors meet only in the buckets that have rows with something in common.

Each row has one number of ``bits`` signs of random projections per band; the numbers of all bands, side by side, are its
sketch. A row is sent once per band as (row, number, sketch). Rows with the same number in a band share a bucket and are
candidates there, unless an earlier band brought them together or their sketches differ in too many signs. A pair so
belongs to one bucket of one tile. What leaves this step are not pairs but the tile's rows that have a candidate; their
vectors are fetched once per row and tile, and the pairs of a bucket are decided on them, exactly, a portion at a time. So
what is sent grows with the rows, and no task holds the pairs of a cluster of copies.

Signs of two vectors at an angle a differ with probability a / pi. So a pair at the threshold is missed by all bands with
probability (1 - p**bits)**bands, p = 1 - a / pi, and by the sketch with a binomial tail; each gets half of ``miss``,
whether or not the two depend on each other, and closer pairs are missed less. Bits are chosen by cost: more of them mean
fewer candidates and more bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Block, VectorColumn, exact_cosine, subgroups
from ..session import materialize
from .blocks import BLOCK_ROWS, TILE_BYTES, plan_blocks, self_tiles

#: More bands than this cost more than they save; the threshold or the miss is too low for signatures.
MAX_BANDS = 1024
#: What one row of one band costs, and each byte of its sketch, in comparisons of two sketches.
_ROW_COST = 200.0
_BYTE_COST = 4.0
#: Comparisons of sketches at a time, and bytes of what is compared or decided at a time.
_PAIRS = 1 << 17
_BYTES = 8 << 20
#: Buckets of fewer rows are compared together; of others, so many words of 64 signs first (a byte holds how many differ).
_FEW = 48
_WORDS = 3


def bands_for(same_bit: float, bits: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(same_bit**bits, 1.0 - 1e-12))))


def sketch_width(bits: int) -> int:
    """Bytes of the number of one band."""
    return 1 if bits <= 8 else 2 if bits <= 16 else 4


def plan_signatures(threshold: float, sizes: Sequence[int], miss: float) -> tuple[int, int, int]:
    """Bits and bands of least cost for groups of these sizes, and the signs in which sketches may differ.

    Raises where no number of bits gets by with ``MAX_BANDS``.
    """
    if not 0.0 < miss < 1.0:
        raise ValueError("miss lies between 0 and 1")
    share = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    rows, pairs = float(sum(sizes)), sum(n * n / 2.0 for n in sizes)
    best = None
    for bits in range(2, 32):
        bands = bands_for(1.0 - share, bits, miss / 2)
        cost = bands * (rows * (_ROW_COST + _BYTE_COST * bands * sketch_width(bits)) + pairs * 0.5**bits)
        if bands <= MAX_BANDS and (best is None or cost < best[0]):
            best = cost, bits, bands
    if best is None:
        raise ValueError(f"a threshold of {threshold} and a miss of {miss} need more than {MAX_BANDS} bands")
    return best[1], best[2], allowed_differences(share, miss / 2, best[1] * best[2])


def allowed_differences(share: float, miss: float, signs: int) -> int:
    """The least number that so many of ``signs``, each differing with this probability, exceed with probability ``miss`` at most."""
    if share <= 0.0:
        return 0
    tail, n = 1.0, 0
    while True:
        chance = math.lgamma(signs + 1) - math.lgamma(n + 1) - math.lgamma(signs - n + 1)
        tail -= math.exp(chance + n * math.log(share) + (signs - n) * math.log1p(-share)) if share < 1.0 else float(n == signs)
        # Sums near the end are rounding; a bound of all signs drops nothing.
        if tail <= miss * 0.5 or n == signs:
            return n
        n += 1


def _signed(keys: list[str], bits: int, bands: int, seed: int):
    """Rows with their number in each band (``_sigs``), and these as bytes (``_sketch``)."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    width = sketch_width(bits)
    # Whole words: bytes beyond the last band are zero in all rows.
    length = -(-bands * width // 8) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = VectorColumn(batch.column("embedding"))
            for dim in np.unique(vectors.dims[vectors.dims > 0]).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * bands)).astype(np.float32)
                rows = np.flatnonzero(vectors.dims == dim)
                for some in np.array_split(rows, -(-len(rows) // 2048)):
                    signs = vectors.block(some).values.astype(np.float32) @ planes[dim] >= 0
                    numbers = signs.reshape(len(some), bands, bits) @ weights
                    n = len(some)
                    at = pa.array(some)
                    data = np.zeros((n, length // width), f"u{width}")
                    data[:, :bands] = numbers
                    sigs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(numbers.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(at) for k in keys], batch.column("id").take(at), batch.column("embedding").take(at),
                         pa.array(np.full(n, dim, np.int32)), sigs,
                         pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), n, [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())],
                        names=[*keys, "id", "embedding", "_dim", "_sigs", "_sketch"])

    return run


def _sketches(table: pa.Table) -> np.ndarray:
    """The sketches of a table, one row of bytes each."""
    return np.frombuffer(b"".join(table.column("_sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _first_together(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which of the pairs, that share the number of ``band``, share none before. ``sketches`` holds numbers."""
    out = np.empty(len(a), bool)
    step = max(1, _BYTES // max(1, sketches.shape[1] * sketches.itemsize))
    for lo in range(0, len(a), step):
        some = slice(lo, lo + step)
        out[some] = (sketches[a[some]] == sketches[b[some]]).argmax(axis=1) == band[some]
    return out


def _alike(words: np.ndarray, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, allowed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row a and each row from ``starts`` to ``ends`` of a, if their sketches differ in at most ``allowed`` signs.

    Rows stand by bucket (``code``), and those of a bucket end with the same row.
    """
    counts = np.maximum(ends - starts, 0)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    large = np.append(first[1:], len(code)) - first >= _FEW
    few = np.flatnonzero(~np.repeat(large, np.diff(np.append(first, len(code)))) & (counts > 0))
    total, low = np.cumsum(counts[few]), 0
    while low < len(few):
        high = max(int(np.searchsorted(total, (total[low - 1] if low else 0) + _PAIRS, "right")), low + 1)
        rows, size = few[low:high], counts[few[low:high]]
        a = np.repeat(rows, size)
        b = np.arange(int(size.sum())) + np.repeat(starts[rows] - (np.cumsum(size) - size), size)
        differ = np.zeros(len(a), np.uint32)
        for word in range(words.shape[1]):
            differ += np.bitwise_count(words[a, word] ^ words[b, word])
        close = differ <= allowed
        yield a[close], b[close]
        low = high
    columns = np.ascontiguousarray(words.T)
    for lo, end in zip(first[large], np.append(first[1:], len(code))[large]):
        while lo < end and counts[lo]:
            start, stop = int(starts[lo]), int(ends[lo])
            high = min(end, lo + max(1, _PAIRS // (stop - start)))
            differ = np.zeros((high - lo, stop - start), np.uint8)
            for column in columns[:_WORDS]:
                differ += np.bitwise_count(column[lo:high, None] ^ column[None, start:stop])
            differ = differ.ravel()
            maybe = np.flatnonzero(differ <= allowed)
            a, b = np.divmod(maybe, stop - start)
            a, b = a + lo, b + start
            differ = differ[maybe].astype(np.uint32)
            for column in columns[_WORDS:]:
                differ += np.bitwise_count(column[a] ^ column[b])
            a, b = a[differ <= allowed], b[differ <= allowed]
            # The rows after the first of these start later, or have nothing to meet.
            met = (b >= starts[a]) & (b < ends[a])
            yield a[met], b[met]
            lo = high


def _close_sketches(keys: list[str], bucket: list[str], allowed: int, width: int = 1, rows_as: list[str] | None = None):
    """Pairs of a tile in one bucket whose sketches differ in at most ``allowed`` signs and that share no earlier band.

    ``rows_as``: instead of the pairs, these columns of the rows that are in one.
    """
    schema = pa.schema([*[(k, pa.string()) for k in keys], ("id_a", pa.int64()), ("id_b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        code = np.zeros(n, np.int64)
        for name in [*bucket, "_i", "_j"]:
            column = table.column(name).combine_chunks()
            numbers = column.dictionary_encode().indices.fill_null(-1).to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
            _, part = np.unique(numbers, return_inverse=True)
            code = np.unique(code * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1]
        block, i_of, j_of, band = (table.column(c).to_numpy() for c in ("_b", "_i", "_j", "_band"))
        same, second = i_of == j_of, (block == j_of) & (i_of != j_of)
        # Buckets one after the other, in each the first block before the second.
        order = np.lexsort((second, code))
        code, same, second = code[order], same[order], second[order]
        ends = np.searchsorted(code, code, "right")
        # A row meets the rows after it; of two blocks, one of the first meets all of the second.
        starts = np.where(same, np.arange(n) + 1, ends - np.bincount(code, second, int(code.max(initial=0)) + 1).astype(np.int64)[code] if n else 0)
        starts = np.where(same | ~second, starts, ends)
        sketches = _sketches(table)[order]
        numbers, band = sketches.view(f"u{width}"), band[order]
        found = np.zeros(n, bool)
        pairs = []
        for a, b in _alike(sketches.view(np.uint64), code, starts, ends, allowed):
            new = _first_together(numbers, a, b, band[a])
            a, b = a[new], b[new]
            if rows_as is None:
                pairs.append((order[a], order[b]))
            else:
                found[order[a]] = found[order[b]] = True
        if rows_as is not None:
            return table.select(rows_as).filter(pa.array(found))
        ids = table.column("id").to_numpy()
        one, two = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*pairs) if pairs else ((), ())))
        swap = ids[one] > ids[two]
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        picks = pa.array(one)
        return pa.table([*[table.column(k).take(picks).combine_chunks() for k in keys], pa.array(ids[one]), pa.array(ids[two])], schema=schema)

    return run


def _met(keys: list[str], bucket: list[str], threshold: float, width: int = 1):
    """Pairs of the rows of a tile in one bucket that share no earlier band and have a cosine of ``threshold`` at least, in portions.

    Rows of one id are no pair.
    """
    schema = pa.schema([*[(k, pa.string()) for k in keys], ("id_a", pa.int64()), ("id_b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, block, i_of, j_of, band = (table.column(c).to_numpy() for c in ("id", "_b", "_i", "_j", "_band"))
        names = {k: table.column(k).combine_chunks() for k in keys}
        numbers = _sketches(table).view(f"u{width}")
        vectors = VectorColumn(table.column("embedding"))
        others = [table.column(c).to_numpy() for c in bucket if c not in keys]
        for rows in subgroups(table, keys, i_of, j_of, *others):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            same = i_of[rows[0]] == j_of[rows[0]]
            left = rows if same else rows[block[rows] == i_of[rows[0]]]
            right = rows if same else rows[block[rows] == j_of[rows[0]]]
            if not len(left) or not len(right) or (same and len(rows) < 2):
                continue
            a = vectors.block(left)
            b = a if same else vectors.block(right)
            step = max(1, _PAIRS // len(right))
            check = max(1, _BYTES // (8 * a.values.shape[1]))
            for lo in range(0, len(left), step):
                # In one block the rows go by id, and a row meets those after it.
                start = lo + 1 if same else 0
                if start >= len(right):
                    break
                near = a.unit[lo:lo + step] @ b.unit[start:].T >= np.float32(threshold - a.slack)
                r, c = np.divmod(np.flatnonzero(near), len(right) - start)
                r, c = r + lo, c + start
                if same:
                    r, c = r[r < c], c[r < c]
                new = (ids[left[r]] != ids[right[c]]) & _first_together(numbers, left[r], right[c], band[left[r]])
                r, c = r[new], c[new]
                for at in range(0, len(r), check):
                    ra, cb = r[at:at + check], c[at:at + check]
                    sims = exact_cosine(a, ra, b, cb)
                    ok = sims >= threshold
                    one, two, sims = left[ra[ok]], right[cb[ok]], sims[ok]
                    if len(one):
                        picks = pa.array(one)
                        yield pa.RecordBatch.from_arrays(
                            [*[names[k].take(picks) for k in keys], pa.array(np.minimum(ids[one], ids[two])),
                             pa.array(np.maximum(ids[one], ids[two])), pa.array(sims)], schema=schema)

    return run


def _decided(keys: list[str], threshold: float):
    schema = pa.schema([*[(k, pa.string()) for k in keys], ("id_a", pa.int64()), ("id_b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = VectorColumn(batch.column("one")), VectorColumn(batch.column("two"))
            for dim in np.unique(one.dims).tolist():
                rows = np.flatnonzero((one.dims == dim) & (two.dims == dim))
                if not len(rows):
                    continue
                each = np.arange(len(rows))
                sims = exact_cosine(Block(one.block(rows).values), each, Block(two.block(rows).values), each)
                ok = pa.array(rows[sims >= threshold])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(ok) for c in (*keys, "id_a", "id_b")], pa.array(sims[sims >= threshold])], schema=schema)

    return run


def _repeated(rows: DataFrame, threshold: float, keys: list[str], ddl: str) -> DataFrame:
    """Each row of an id that comes more than once, with each row of it, if two of them match."""
    again = rows.groupBy(*keys, "id").count().where("count > 1").select(*keys, "id")
    twice = rows.join(again, [*keys, "id"], "left_semi")
    one, two = (twice.select(*keys, "id", F.col("_row").alias(f"_{name}"), F.col("embedding").alias(name)) for name in ("one", "two"))
    each = one.join(two, [*keys, "id"]).select(*keys, F.col("id").alias("id_a"), F.col("id").alias("id_b"), "one", "two", "_one", "_two")
    found = each.where("_one != _two").mapInArrow(_decided(keys, threshold), f"{ddl}, id_a bigint, id_b bigint, similarity double")
    every = each.join(found.select(*keys, "id_a").distinct(), [*keys, "id_a"], "left_semi")
    return every.mapInArrow(_decided(keys, threshold), f"{ddl}, id_a bigint, id_b bigint, similarity double")


def sketched_pairs(rows: DataFrame, threshold: float, miss: float, keys: Sequence[str], *, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """Pairs (id_a < id_b) of ``rows`` (keys, id, embedding) with a cosine of ``threshold`` at least; one at it is missed with probability ``miss``."""
    keys = list(keys)
    ddl = ", ".join(f"{k} string" for k in keys)
    # A row without a group or an id pairs with none.
    rows = rows.dropna(subset=[*keys, "id"])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.max(F.size("embedding")).alias("widest"))
    # Groups by the power of two of their size: few lines, whatever the number of groups.
    binned = sizes.groupBy(F.ceil(F.log2("count")).alias("b")).agg(
        F.count(F.lit(1)).alias("groups"), F.max("count").alias("n"), F.max("widest").alias("widest")).collect()
    if not binned:
        return rows.sparkSession.createDataFrame([], f"{ddl}, id_a bigint, id_b bigint, similarity double")
    bits, bands, allowed = plan_signatures(threshold, [r["n"] for r in binned for _ in range(min(r["groups"], 1000))], miss)
    # A tile has two blocks at most, and their vectors.
    block_rows = min(block_rows, max(64, TILE_BYTES // (4 * max(1, *[r["widest"] for r in binned]))))
    signed = rows.select(*keys, "id", "embedding").mapInArrow(
        _signed(keys, bits, bands, seed), f"{ddl}, id bigint, embedding array<float>, _dim int, _sigs array<int>, _sketch binary")
    # Written, so that a row keeps its number and its sketch.
    signed = materialize(signed.withColumn("_row", F.monotonically_increasing_id()), "sketches")
    bucket = [*keys, "_dim", "_band", "_sig"]
    banded = signed.select(*keys, "_row", "_dim", "_sketch", F.posexplode("_sigs").alias("_band", "_sig"))
    tiles = self_tiles(banded, plan_blocks([banded], bucket, block_rows), "_row")
    found = ["_tile", "_row", "_i", "_j", "_b", "_band", "_sig"]
    close = tiles.groupBy("_tile").applyInArrow(
        _close_sketches(keys, bucket, allowed, sketch_width(bits), found), "_tile bigint, _row bigint, _i int, _j int, _b int, _band int, _sig int")
    met = close.join(signed.drop("_sigs"), "_row").drop("_row")
    pairs = met.groupBy("_tile").applyInArrow(_met(keys, bucket, threshold, sketch_width(bits)), f"{ddl}, id_a bigint, id_b bigint, similarity double")
    return pairs.unionByName(_repeated(signed, threshold, keys, ddl))
