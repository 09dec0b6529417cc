"""What happens inside one tile: a blocked matrix product and the matches it yields.

Each kernel gets one bounded Arrow table. A float32 product filters candidates with a rounding
allowance, then every candidate is decided on the exact double cosine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..functions.vectors import Block, VectorColumn, exact_cosine, passes, subgroups

_STEP = 512
_CHECK = 65_536


def _candidates(a: Block, b: Block, lo: int, hi: int, threshold: float) -> np.ndarray:
    """Which pairs of a chunk may pass: the filter is lowered by more than it can be off."""
    return a.unit[lo:hi] @ b.unit.T >= np.float32(threshold - a.slack)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _strings(table: pa.Table, names: list[str], rows: np.ndarray) -> dict[str, pa.Array]:
    picks = pa.array(rows)
    return {n: table.column(n).take(picks).combine_chunks() for n in names}


def _bucket(table: pa.Table, banded: bool) -> list[np.ndarray]:
    """Columns that tell signature buckets apart, where tiles are made of buckets."""
    return _columns(table, "_band", "_sig") if banded and "_band" in table.column_names else []


def _result(parts: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables(parts) if parts else schema.empty_table()


def _schema(keys: list[str], *fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([(k, pa.string()) for k in keys] + list(fields))


def _make(table: pa.Table, keys: list[str], at: np.ndarray, schema: pa.Schema, **values) -> pa.Table:
    data = _strings(table, keys, at)
    data.update({k: pa.array(v) for k, v in values.items()})
    return pa.table({f.name: data[f.name].cast(f.type) for f in schema}, schema=schema)


# Directions of the first look at a pair; wider vectors are compared whole only where it leaves them a chance.
_HEAD = 24


def _heads(block: Block) -> np.ndarray | None:
    """Unit vectors in a few random directions, and the length of what is left of each: their product bounds the cosine from above."""
    dim = block.unit.shape[1]
    if dim < 2 * _HEAD:
        return None
    turned, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, _HEAD)))
    head = block.unit @ turned.astype(np.float32)
    rest = np.einsum("ij,ij->i", block.unit, block.unit, dtype=np.float64) - np.einsum("ij,ij->i", head, head, dtype=np.float64)
    # Rounding of a length near zero is as large as the root of that of its square.
    return np.column_stack([head, np.sqrt(np.maximum(rest, 0.0) + block.slack)]).astype(np.float32)


def _likely(a: Block, b: Block, head_a, head_b, lo: int, hi: int, end: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the candidates among rows lo to hi and columns up to ``end``: the same as of ``_candidates``."""
    least = np.float32(threshold - a.slack)
    if head_a is not None:
        # The product of two heads has its own rounding; the added slack covers it.
        open_pairs = head_a[lo:hi] @ head_b[:end].T >= np.float32(threshold - 2 * a.slack)
        if np.count_nonzero(open_pairs) * 32 <= open_pairs.size:
            r, c = np.divmod(np.flatnonzero(open_pairs), end)
            near = np.empty(len(r), bool)
            for at in range(0, len(r), _CHECK):
                some = slice(at, at + _CHECK)
                near[some] = np.einsum("ij,ij->i", a.unit[lo + r[some]], b.unit[c[some]]) >= least
            return r[near], c[near]
    return np.divmod(np.flatnonzero(a.unit[lo:hi] @ b.unit[:end].T >= least), end)


def _smallest_per_slot(r, c, slots, a, lo, b, threshold, strict, wanted):
    """For each row and slot of the candidates, up to ``wanted`` hits in column order: (row, column, similarity, more left)."""
    code = r * (int(slots.max()) + 1) + slots[c]
    order = np.argsort(code, kind="stable")
    r, c, code = r[order], c[order], code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    end = np.append(first[1:], len(code))
    at, found = first.copy(), np.zeros(len(first), np.int64)
    live = np.arange(len(first))
    hits, of, sims = [], [], []
    while len(live):
        here = at[live]
        s = exact_cosine(a, lo + r[here], b, c[here])
        ok = passes(s, threshold, strict)
        hits.append(here[ok])
        of.append(live[ok])
        sims.append(s[ok])
        found[live[ok]] += 1
        at[live] += 1
        live = live[(found[live] < wanted) & (at[live] < end[live])]
    hit, of = np.concatenate(hits), np.concatenate(of)
    return r[hit], c[hit], np.concatenate(sims), (at < end)[of]


def _smallest_hits(mask, a, rows_a, b, threshold, strict, wanted):
    """For each row of a chunk, up to ``wanted`` hits in column order: (row, column, similarity).

    ``mask`` holds the candidates left; it is consumed. Also tells which rows may have more.
    """
    out_r, out_c, out_s = [], [], []
    found = np.zeros(len(mask), np.int64)
    open_rows = np.flatnonzero(mask.any(axis=1))
    while len(open_rows):
        cols = mask[open_rows].argmax(axis=1)
        mask[open_rows, cols] = False
        sims = exact_cosine(a, rows_a[open_rows], b, cols)
        ok = passes(sims, threshold, strict)
        out_r.append(open_rows[ok])
        out_c.append(cols[ok])
        out_s.append(sims[ok])
        found[open_rows[ok]] += 1
        open_rows = open_rows[(found[open_rows] < wanted) & mask[open_rows].any(axis=1)]
    more = mask.any(axis=1)
    if not out_r:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0), more
    return np.concatenate(out_r), np.concatenate(out_c), np.concatenate(out_s), more


def pair_kernel(keys: list[str], threshold: float, strict: bool, banded: bool = False) -> Callable:
    """All matching pairs (id_a < id_b) of a tile.

    With bands, a tile is one signature bucket and a pair is left to the first band it shares, so
    that it comes out once.
    """
    schema = _schema(keys, ("id_a", pa.int64()), ("id_b", pa.int64()), ("similarity", pa.float64()))

    def run(table: pa.Table) -> pa.Table:
        ids, block, i_of, j_of = _columns(table, "id", "_b", "_i", "_j")
        vectors = VectorColumn(table.column("embedding"))
        bucket = _bucket(table, banded)
        if banded:
            band = bucket[0]
            width = len(table.column("_sigs")[0]) if table.num_rows else 0
            signatures = table.column("_sigs").combine_chunks().flatten().to_numpy().reshape(-1, max(width, 1))
        parts = []
        for rows in subgroups(table, keys, i_of, j_of, vectors.dims, *bucket):
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(ids[rows], kind="stable")]
            same = i_of[rows[0]] == j_of[rows[0]]
            left = rows if same else rows[block[rows] == i_of[rows[0]]]
            right = rows if same else rows[block[rows] == j_of[rows[0]]]
            if not len(left) or not len(right):
                continue
            a = vectors.block(left)
            b = a if same else vectors.block(right)
            for lo in range(0, len(left), _STEP):
                hi = min(lo + _STEP, len(left))
                hit = _candidates(a, b, lo, hi, threshold)
                if same:
                    hit &= np.arange(lo, hi)[:, None] < np.arange(len(right))[None, :]
                r, c = np.nonzero(hit)
                for start in range(0, len(r), _CHECK):
                    ra, cb = r[start:start + _CHECK] + lo, c[start:start + _CHECK]
                    sims = exact_cosine(a, ra, b, cb)
                    ok = passes(sims, threshold, strict)
                    ra, cb, sims = left[ra[ok]], right[cb[ok]], sims[ok]
                    if banded:
                        first = (signatures[ra] == signatures[cb]).argmax(axis=1) == band[ra]
                        ra, cb, sims = ra[first], cb[first], sims[first]
                    if len(ra):
                        parts.append(_make(
                            table, keys, ra, schema,
                            id_a=np.minimum(ids[ra], ids[cb]), id_b=np.maximum(ids[ra], ids[cb]),
                            similarity=sims,
                        ))
        return _result(parts, schema)

    return run


def first_match_kernel(
    keys: list[str], threshold: float, strict: bool, older_only: bool, banded: bool = False
) -> Callable:
    """For each side-1 row, the side-0 row with the smallest id that matches it, if any."""
    schema = _schema(keys, ("id", pa.int64()), ("match_id", pa.int64()), ("similarity", pa.float64()))

    def run(table: pa.Table) -> pa.Table:
        ids, side, i_of, j_of = _columns(table, "id", "_side", "_i", "_j")
        vectors = VectorColumn(table.column("embedding"))
        parts = []
        for rows in subgroups(table, keys, i_of, j_of, vectors.dims, *_bucket(table, banded)):
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(ids[rows], kind="stable")]
            stored, fresh = rows[side[rows] == 0], rows[side[rows] == 1]
            if not len(stored) or not len(fresh):
                continue
            a, b = vectors.block(fresh), vectors.block(stored)
            for lo in range(0, len(fresh), _STEP):
                hi = min(lo + _STEP, len(fresh))
                mask = _candidates(a, b, lo, hi, threshold)
                if older_only:
                    mask &= ids[stored][None, :] < ids[fresh[lo:hi]][:, None]
                r, c, s, _ = _smallest_hits(mask, a, np.arange(lo, hi), b, threshold, strict, 1)
                if len(r):
                    at = fresh[r + lo]
                    parts.append(_make(table, keys, at, schema, id=ids[at], match_id=ids[stored[c]], similarity=s))
        return _result(parts, schema)

    return run


def greedy_kernel(keys: list[str], threshold: float, strict: bool) -> Callable:
    """Walk complete groups in id order: a kept row removes every later match.

    Rows without a vector match on ``_h`` (text key), as do vector rows facing such a row.
    """
    schema = _schema(keys, ("keep_id", pa.int64()), ("remove_id", pa.int64()), ("similarity", pa.float64()))
    text_matches = bool(passes(np.array([1.0]), threshold, strict)[0])

    def walk(ids, rows, vectors, texts):
        n = len(rows)
        keeper = np.full(n, -1, np.int64)
        score = np.zeros(n)
        dims = vectors.dims[rows]
        followers: dict[int, np.ndarray] = {}
        if text_matches and (dims < 0).any():
            order = np.argsort(texts[rows], kind="stable")
            for peers in np.split(order, np.flatnonzero(np.diff(texts[rows][order])) + 1):
                if texts[rows[peers[0]]] >= 0 and (dims[peers] < 0).any():
                    followers.update({int(p): peers for p in peers})
        hits: dict[int, np.ndarray] = {}
        for dim in np.unique(dims[dims >= 0]):
            members = np.flatnonzero(dims == dim)
            block = vectors.block(rows[members])
            for lo in range(0, len(members), _STEP):
                hi = min(lo + _STEP, len(members))
                mask = _candidates(block, block, lo, hi, threshold)
                mask &= np.arange(lo, hi)[:, None] < np.arange(len(members))[None, :]
                for r in np.flatnonzero(mask.any(axis=1)):
                    hits[int(members[r + lo])] = (block, r + lo, np.flatnonzero(mask[r]), members)
        for p in sorted(hits.keys() | followers.keys()):
            if keeper[p] >= 0:
                continue
            if p in hits:
                block, r, cols, members = hits[p]
                cols = cols[keeper[members[cols]] < 0]
                if len(cols):
                    sims = exact_cosine(block, np.full(len(cols), r), block, cols)
                    ok = passes(sims, threshold, strict)
                    keeper[members[cols[ok]]], score[members[cols[ok]]] = p, sims[ok]
            if p in followers:
                peers = followers[p]
                peers = peers[(peers > p) & (keeper[peers] < 0) & ((dims[peers] < 0) | (dims[p] < 0))]
                keeper[peers], score[peers] = p, 1.0
        gone = np.flatnonzero(keeper >= 0)
        return rows[gone], rows[keeper[gone]], score[gone]

    def run(table: pa.Table) -> pa.Table:
        (ids,) = _columns(table, "id")
        vectors = VectorColumn(table.column("embedding"))
        code = table.column("_h").combine_chunks().dictionary_encode()
        texts = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        parts = []
        for rows in subgroups(table, keys):
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(ids[rows], kind="stable")]
            gone, kept, score = walk(ids, rows, vectors, texts)
            if len(gone):
                parts.append(_make(table, keys, gone, schema, keep_id=ids[kept], remove_id=ids[gone], similarity=score))
        return _result(parts, schema)

    return run


def older_neighbours_kernel(
    keys: list[str], threshold: float, strict: bool, wanted: int, banded: bool = False
) -> Callable:
    """For each undecided row of a tile, its ``wanted`` smallest older matches and whether more may exist.

    ``slot`` is the block (and band) the matches are from: one list per row and slot. A tile may hold several blocks on a
    side. Both sides go by id, so a row meets only the part of the other side that is older.
    """
    schema = _schema(
        keys, ("id", pa.int64()), ("older_id", pa.int64()), ("similarity", pa.float64()), ("more", pa.bool_()),
        ("slot", pa.int64()),
    )

    def run(table: pa.Table) -> pa.Table:
        ids, block, i_of, j_of, undecided = _columns(table, "id", "_b", "_i", "_j", "undecided")
        vectors = VectorColumn(table.column("embedding"))
        bucket = _bucket(table, banded)
        slot_of = _columns(table, "_slot")[0].astype(np.int64) if "_slot" in table.column_names else block.astype(np.int64)
        parts = []
        for rows in subgroups(table, keys, i_of, j_of, vectors.dims, *bucket):
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(ids[rows], kind="stable")]
            if i_of[rows[0]] == j_of[rows[0]]:
                sides = [(rows, rows)]
            else:
                first, second = rows[block[rows] == i_of[rows[0]]], rows[block[rows] == j_of[rows[0]]]
                sides = [(first, second), (second, first)]
            above = int(bucket[0][rows[0]]) << 32 if banded else 0
            for asking, others in sides:
                asking = asking[undecided[asking]]
                if not len(asking) or not len(others):
                    continue
                a, b = vectors.block(asking), vectors.block(others)
                wide = len(asking) * len(others) > _CHECK
                head_a, head_b = (_heads(a), _heads(b)) if wide else (None, None)
                slots, ids_a, ids_b = slot_of[others], ids[asking], ids[others]
                ends = np.searchsorted(ids_b, ids_a)
                step = max(64, min(_STEP, _STEP * 8192 // len(others)))
                for lo in range(0, len(asking), step):
                    hi = min(lo + step, len(asking))
                    end = int(ends[hi - 1])
                    if not end:
                        continue
                    r, c = _likely(a, b, head_a, head_b, lo, hi, end, threshold)
                    older = c < ends[lo + r]
                    r, c = r[older], c[older]
                    if not len(r):
                        continue
                    r, c, s, more = _smallest_per_slot(r, c, slots, a, lo, b, threshold, strict, wanted)
                    if len(r):
                        at = asking[r + lo]
                        parts.append(_make(
                            table, keys, at, schema,
                            id=ids[at], older_id=ids_b[c], similarity=s, more=more, slot=slots[c] + above,
                        ))
        return _result(parts, schema)

    return run


def ranked_hits_kernel(keys: list[str], threshold: float) -> Callable:
    """Entries (side 0) above the threshold for each query (side 1), cut to the query's own limit."""
    schema = _schema(
        keys, ("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("lim", pa.int32())
    )

    def run(table: pa.Table) -> pa.Table:
        ids, side, i_of, j_of = _columns(table, "id", "_side", "_i", "_j")
        limits = table.column("lim").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        wanted_tags = table.column("tag").to_pylist()
        vectors = VectorColumn(table.column("embedding"))
        tags = table.column("tags")
        parts = []
        for rows in subgroups(table, keys, i_of, j_of, vectors.dims):
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(ids[rows], kind="stable")]
            entries, asking = rows[side[rows] == 0], rows[side[rows] == 1]
            if not len(entries) or not len(asking):
                continue
            entry_block, query_block = vectors.block(entries), vectors.block(asking)
            tag_masks = {
                tag: np.array([tag in (tags[int(e)].as_py() or ()) for e in entries])
                for tag in {wanted_tags[q] for q in asking} if tag
            }
            for lo in range(0, len(asking), _STEP):
                hi = min(lo + _STEP, len(asking))
                mask = _candidates(query_block, entry_block, lo, hi, threshold)
                for q in np.flatnonzero(mask.any(axis=1)):
                    at = asking[q + lo]
                    hit = mask[q] & tag_masks[wanted_tags[at]] if wanted_tags[at] else mask[q]
                    cols = np.flatnonzero(hit)
                    sims = exact_cosine(query_block, np.full(len(cols), q + lo), entry_block, cols)
                    ok = sims > threshold
                    cols, sims = cols[ok], sims[ok]
                    best = np.lexsort((ids[entries[cols]], -sims))
                    if limits[at] > 0:
                        best = best[: limits[at]]
                    if len(best):
                        parts.append(_make(
                            table, keys, entries[cols[best]], schema,
                            query_id=np.full(len(best), ids[at]), id=ids[entries[cols[best]]],
                            similarity=sims[best], lim=np.full(len(best), limits[at]),
                        ))
        return _result(parts, schema)

    return run
