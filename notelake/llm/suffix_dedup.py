"""Repeated byte strings by difference-cover suffix arrays.

Two equal strings of ``length`` bytes hold the same substring of ``gram`` bytes with the smallest
hash, their *anchor*, so suffixes that can share so long a prefix always belong to one anchor. Spark
deals the text by anchor, and each task sorts the suffixes of its share:

1. Anchors found once end there. About one byte in 35 starts an anchor.
2. Neighbouring strings with one anchor at one place travel as a run. Of equal runs the first stays, by a
   pre-aggregated minimum; the strings of the others all start earlier.
3. The first runs of anchors with different surroundings go to the suffix sorter: sort sampled
   triples, recurse on their names, merge the remaining suffixes, then compare the prefixes of
   neighbours (``suffix_array``, ``_repeats``). A task works through its anchors in portions of
   ``PORTION`` bytes, whatever its share.
4. An anchor with more than ``CROWD`` different surroundings would be one large group in one task.
   Its strings are dealt by their own content instead and settled by a pre-aggregated minimum.

Defined results: null text counts as empty; matches never cross rows; texts shorter than ``length``
keep everything; rows without doc_id come after all others; rows of equal doc_id but different text
are ordered by a hash of both, and repeated rows (equal doc_id and text) count as one row and have one
result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import free_name, given_id, keyed, row_key, settled

LENGTH, GRAM = 100, 32
CROWD = 2048
PORTION = 1 << 20
_RUNS = "m long, ctx long, id long, key long, a int, w int"
_PIECES = "m long, id long, key long, a int, piece binary"
_WINDOWS = "h1 long, h2 long, id long, key long, a int"
_SPANS = "key long, a int, w int"


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` in the order of its suffixes. Values: 1 to 2**21 - 1, and at most as many positions."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = s
    # Sampled positions: those not divisible by three, and one past the end so that every class-0 suffix has a ranked next.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    triples = padded[sampled] << 42 | padded[sampled + 1] << 21 | padded[sampled + 2]
    distinct, names = np.unique(triples, return_inverse=True)
    if len(distinct) == len(sampled):
        order = sampled[np.argsort(names, kind="stable")]
    else:
        order = sampled[suffix_array(names + 1)]
    rank = np.zeros(n + 4, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(padded[zeros] << 21 | rank[zeros + 1], kind="stable")]
    order = order[order < n]
    one, two = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(padded[one] << 21 | rank[one + 1], padded[zeros] << 21 | rank[zeros + 1])
    before += np.searchsorted(padded[two] << 42 | padded[two + 1] << 21 | rank[two + 2], padded[zeros] << 42 | padded[zeros + 1] << 21 | rank[zeros + 2])
    merged = np.full(n, -1, np.int64)
    merged[np.arange(len(zeros)) + before] = zeros
    merged[merged < 0] = order
    return merged


def _same_prefix(text: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    same = np.arange(len(p))
    for i in range(length):
        same = same[text[p[same] + i] == text[q[same] + i]]
    out = np.zeros(len(p), bool)
    out[same] = True
    return out


def _anchors(length: int, gram: int, runs: bool):
    """Runs of neighbouring strings of one row with one anchor; without ``runs`` only the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in K.slices(b, "text")):
            raw, rows = K.utf8(piece.column("text"))
            at = K.windows_in_rows(rows, length)
            if not len(at):
                continue
            rolling = K.Rolling(K.byte_codes(raw), K.BYTE_BASE)
            grams = np.arange(len(raw) - gram + 1)
            hashes = rolling.of(grams, grams + gram)
            place = K.least_places(hashes, length - gram + 1)[at]
            anchor = hashes[place]
            new = np.ones(len(at), bool)
            new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            if not runs:
                yield pa.record_batch({"m": K.signed(anchor[first])})
                continue
            sizes = np.diff(np.append(first, len(at)))
            a = at[first]
            row = np.searchsorted(rows, a, "right") - 1
            yield pa.record_batch({
                "m": K.signed(anchor[first]), "ctx": K.signed(rolling.of(a, a + sizes + length - 1)),
                "id": piece.column("id").to_numpy()[row], "key": piece.column("key").to_numpy()[row],
                "a": (a - rows[row]).astype(np.int32), "w": sizes.astype(np.int32),
            })

    return run


def _open_runs(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row, start and number of strings of each run, and its anchor."""
    raw, rows = K.utf8(piece.column("text"))
    row = np.repeat(np.arange(len(piece)), piece.column("runs").value_lengths().to_numpy())
    fields = piece.column("runs").flatten()
    return raw, row, fields.field("a").to_numpy() + rows[row], fields.field("w").to_numpy(), fields.field("m").to_numpy()


def _pieces(length: int):
    """The bytes of each open run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in K.slices(b, "text")):
            raw, row, at, sizes, m = _open_runs(part)
            bounds = np.append(0, np.cumsum(sizes + length - 1))
            data = raw[K.ranges(at, sizes + length - 1)]
            _, rows = K.utf8(part.column("text"))
            yield pa.record_batch({
                "m": m, "id": part.column("id").to_numpy()[row], "key": part.column("key").to_numpy()[row],
                "a": (at - rows[row]).astype(np.int32),
                "piece": pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]),
            })

    return run


def _single_strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in K.slices(b, "text")):
            raw, row, at, sizes, _ = _open_runs(part)
            at, row = K.ranges(at, sizes), np.repeat(row, sizes)
            _, rows = K.utf8(part.column("text"))
            codes = K.byte_codes(raw)
            yield pa.record_batch({
                "h1": K.signed(K.Rolling(codes, K.BYTE_BASE).of(at, at + length)),
                "h2": K.signed(K.Rolling(K.mixed(codes, 5), K.WIDE_BASE).of(at, at + length)),
                "id": part.column("id").to_numpy()[row], "key": part.column("key").to_numpy()[row],
                "a": (at - rows[row]).astype(np.int32),
            })

    return run


def _portion_repeats(length: int, id_: np.ndarray, key: np.ndarray, a: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Suffix array of some pieces; the strings that also start earlier, as stretches (key, a, w)."""
    sizes = np.diff(bounds)
    text = np.zeros(len(data) + len(sizes), np.int64)  # a zero after each piece
    starts = bounds[:-1] + np.arange(len(sizes))
    text[K.ranges(starts, sizes)] = data.astype(np.int64) + 1
    order = suffix_array(text + 1)  # the sorter's values start at 1
    piece = np.searchsorted(starts, order, "right") - 1
    whole = order + length <= starts[piece] + sizes[piece]
    order, piece = order[whole], piece[whole]
    place = a[piece] + (order - starts[piece])
    same = np.append(False, _same_prefix(text, order[:-1], order[1:], length))
    by_age = np.lexsort((place, key[piece], id_[piece]))
    # Equal (id, key, place) are one string that several runs hold.
    fresh = np.ones(len(order), bool)
    i, j = by_age[1:], by_age[:-1]
    fresh[1:] = (place[i] != place[j]) | (key[piece[i]] != key[piece[j]]) | (id_[piece[i]] != id_[piece[j]])
    age = np.empty(len(order), np.int64)
    age[by_age] = np.cumsum(fresh)
    heads = np.flatnonzero(~same)
    oldest = np.repeat(np.minimum.reduceat(age, heads), np.diff(np.append(heads, len(order)))) if len(order) else age
    later = np.flatnonzero(age > oldest)
    later = later[np.lexsort((place[later], key[piece[later]]))]
    keys, places = key[piece[later]], place[later]
    new = np.ones(len(later), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (places[1:] > places[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(later))[1:] - 1
    return pa.record_batch({"key": keys[first], "a": places[first].astype(np.int32), "w": (places[last] - places[first] + 1).astype(np.int32)})


def _repeats(length: int, portion: int):
    """Rows: pieces, ordered by anchor within the partition. Whole anchors are sorted together."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, bounds = K.binary(table.column("piece"))
        return _portion_repeats(length, *(table.column(c).to_numpy() for c in ("id", "key", "a")), data, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        before = None
        for batch in batches:
            # Repeated rows give equal pieces, side by side.
            told = [batch.column(c).to_numpy() for c in ("m", "key", "a")]
            fresh = np.append(before is None or before != tuple(x[0] for x in told), np.any([x[1:] != x[:-1] for x in told], axis=0)) if batch.num_rows else np.zeros(0, bool)
            before = tuple(x[-1] for x in told) if batch.num_rows else before
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            m = batch.column("m").to_numpy()
            start = 0
            for stop in [*np.flatnonzero(m[1:] != m[:-1]) + 1, len(m)]:
                group = batch.slice(start, stop - start)
                if size >= portion and held[-1].column("m")[-1].as_py() != m[start]:
                    yield flush(held)
                    held, size = [], 0
                held.append(group)
                size += int(K.binary(group.column("piece"))[1][-1])
                start = stop
        if held:
            yield flush(held)

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, portion: int = PORTION) -> DataFrame:
    """(key, a, w): of the row with this key, the w strings from byte a on also start earlier."""
    if not 1 <= gram < length:
        raise ValueError("an anchor is shorter than a string")
    rows = keyed(docs)
    anchors = rows.mapInArrow(_anchors(length, gram, False), "m long").groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    anchors = settled(anchors.where("n > 1").select("m"), "op9-anchors")
    again = settled(rows.mapInArrow(_anchors(length, gram, True), _RUNS).join(anchors, "m"), "op9-again", anchors)
    first = settled(again.groupBy("m", "ctx").agg(F.min(F.struct("id", "key", "a")).alias("first")), "op9-first")
    around = settled(first.groupBy("m").agg(F.count(F.lit(1)).alias("around")), "op9-around")
    judged = again.join(first, ["m", "ctx"]).join(around, "m").select(
        "m", "key", "a", "w", "around", (F.struct("id", "key", "a") > F.col("first")).alias("later"))
    judged = settled(judged, "op9-judged", again, first, around)
    found = judged.where("later").select("key", "a", "w")
    open_runs = judged.where("not later and around > 1").select("key", "m", "a", "w", (F.col("around") > crowd).alias("crowd")).distinct()
    open_runs = open_runs.groupBy("key", "crowd").agg(F.collect_list(F.struct("m", "a", "w")).alias("runs"))
    pieces = rows.join(open_runs.where("not crowd"), "key").mapInArrow(_pieces(length), _PIECES)
    pieces = pieces.repartition("m").sortWithinPartitions("m", "key", "a")
    sorted_out = settled(pieces.mapInArrow(_repeats(length, portion), _SPANS), "op9-sorted")
    single = settled(rows.join(open_runs.where("crowd"), "key").mapInArrow(_single_strings(length), _WINDOWS), "op9-single")
    least = settled(single.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "a")).alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").drop("n"), "op9-least")
    crowded = single.join(least, ["h1", "h2"]).where(F.struct("id", "key", "a") > F.col("first")).select("key", "a", F.lit(1).cast("int").alias("w"))
    return settled(found.unionByName(sorted_out).unionByName(crowded), "op9-repeated", judged, sorted_out, single, least)


def _cut(piece: pa.RecordBatch, length: int, spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all rows, the rows' first bytes, and which bytes go (rows: text)."""
    raw, rows = K.utf8(piece.column("text"))
    row = np.repeat(np.arange(len(piece)), spans.value_lengths().fill_null(0).to_numpy())
    fields = spans.flatten()
    a = fields.field("a").to_numpy() + rows[row]
    return raw, rows, K.covered(len(raw), a, a + fields.field("w").to_numpy() + length - 1)


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in K.slices(b, "text")):
            raw, rows, cut = _cut(piece, length, piece.column("spans"))
            new = cut.copy()
            new[1:] &= ~cut[:-1]
            edges = rows[1:-1][rows[1:-1] < len(raw)]
            new[edges] = cut[edges]
            gone, begun = (np.append(0, np.cumsum(x))[rows] for x in (cut, new))
            left = (rows - gone).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(raw[~cut]))])
            yield pa.record_batch([piece.column("id"), pa.array(np.diff(rows)), pa.array(np.diff(gone)), pa.array(np.diff(begun)), kept],
                                  ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _rewritten(length: int, columns: list[str], spans: str):
    """The rows with what is left of their texts; a character that lost some of its bytes goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in K.slices(b, "text")):
            raw, rows, cut = _cut(piece, length, piece.column(spans))
            texts = piece.column("text").to_pylist()
            gone = np.append(0, np.cumsum(cut))[rows]
            for i in np.flatnonzero(np.diff(gone)):
                part = slice(rows[i], rows[i + 1])
                texts[i] = raw[part][~cut[part]].tobytes().decode(errors="ignore")
            at = {c: pa.array(texts, pa.string()) if c == "text" else piece.column(c) for c in columns}
            yield pa.record_batch(list(at.values()), list(at))

    return run


def _spans_by_row(docs: DataFrame, length: int) -> DataFrame:
    return repeated_strings(docs, length).distinct().groupBy("key").agg(F.collect_list(F.struct("a", "w")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each row without the bytes of strings that also start earlier: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    cut = keyed(docs).join(_spans_by_row(docs, length), "key", "left").mapInArrow(
        _kept(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select(given_id(), "n_bytes", "n_removed", "n_spans", "kept")


def without_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with shortened texts and all other columns as they are."""
    key, spans = free_name(docs, "_row_key"), free_name(docs, "_spans")
    cuts = _spans_by_row(docs, length).select(F.col("key").alias(key), F.col("spans").alias(spans))
    joined = docs.withColumn(key, row_key()).join(cuts, key, "left").drop(key)
    return joined.mapInArrow(_rewritten(length, docs.columns, spans), docs.schema)
