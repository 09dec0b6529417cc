"""Bounded-space online best-fit packing of token pieces into sequences.

A packer keeps a fixed number of open bins. Bins are keyed by their free space in a bitset, one bit per
size, so the best fit for a piece is the lowest set bit at or above its length, and the fullest bin is the
lowest set bit of all. A piece that fits nowhere opens a bin; if that is one too many, the fullest closes.

Pieces are packed where they are tokenized, one packer per task. What its bins hold open at the end goes
on, as single pieces, to a round where each packer gets ``fan_in`` times the tokens that it can hold open, and so on until one packer is left. It
packs what its own bins still hold open once more, longest first, and closes everything. A round's input
is bounded by the open bins of the round before, never by the table.

The packers' state is bounded: open bins times capacity in tokens. Rounds are written tables, so a lost
executor repeats one task.

Defined results: null text counts as empty, its ids are the end id alone; documents of up to ``capacity``
tokens are never cut, longer ones into pieces of ``capacity`` and a rest; rows without doc_id and repeated rows
are documents like all others; other columns are ignored; an empty table gives no rows. Which piece shares a
sequence with which depends on the partitions of the input, the number of pieces does not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .chunks import encoder, token_bounds
from .scratch import given_id, settled

CAPACITY = 4096
OPEN_BINS = 1024
FAN_IN = 16
_PIECE = "id long, piece int, start long, length long, ids_crc32 long"
_PLACE = "bin long, offset long"


class Packer:
    """Bins of one capacity, of which at most ``open_bins`` are open; each piece is any object with a length."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit s: some open bin has s tokens of free space
        self.by_free: dict[int, list[list]] = {}
        self.n_open = 0

    def _pop(self, space: int) -> list:
        same = self.by_free[space]
        taken = same.pop()
        if not same:
            del self.by_free[space]
            self.free &= ~(1 << space)
        self.n_open -= 1
        return taken

    def add(self, length: int, piece: object) -> list | None:
        """Put the piece into the open bin that it fills best. Gives a bin that closed on its account, if one did."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            content = self._pop(space)
            closed = None
        else:
            space, content = self.capacity, []
            closed = self._pop((self.free & -self.free).bit_length() - 1) if self.n_open == self.open_bins else None
        content.append((length, piece))
        space -= length
        if space == 0:
            # A full bin closes at once; then no bin was over.
            return content if closed is None else self._both(closed, content)
        self.by_free.setdefault(space, []).append(content)
        self.free |= 1 << space
        self.n_open += 1
        return closed

    def _both(self, fullest: list, full: list) -> list:
        """The place is free after all: the fullest opens again, the full one closes."""
        space = self.capacity - sum(n for n, _ in fullest)
        self.by_free.setdefault(space, []).append(fullest)
        self.free |= 1 << space
        self.n_open += 1
        return full

    def drained(self) -> Iterator[list]:
        """The open bins, fullest first."""
        while self.n_open:
            yield self._pop((self.free & -self.free).bit_length() - 1)


def _packed(batches: Iterator[pa.RecordBatch], packer_id: int, last: bool, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """Rows of pieces (n columns, among them length) to the same rows with bin and offset; bin -1: still open."""
    packer, waiting, made = Packer(capacity, open_bins), [], 0

    def close(content: list) -> None:
        nonlocal made
        offset = 0
        for length, row in content:
            waiting.append((*row, (packer_id << 32) + made, offset))
            offset += length
        made += 1

    def flushed() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*waiting), kinds)], names)
        waiting.clear()
        return out

    names = kinds = None
    for batch in batches:
        if names is None:
            names = batch.schema.names + ["bin", "offset"]
            kinds = list(batch.schema.types) + [pa.int64(), pa.int64()]
            at = batch.schema.names.index("length")
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            closed = packer.add(row[at], row)
            if closed is not None:
                close(closed)
        if len(waiting) > 8192:
            yield flushed()
    if last:
        rest = sorted((p for content in packer.drained() for p in content), key=lambda p: p[0], reverse=True)
        final = Packer(capacity, max(len(rest), 1))
        for length, row in rest:
            closed = final.add(length, row)
            if closed is not None:
                close(closed)
        for content in final.drained():
            close(content)
    else:
        waiting.extend((*row, -1, -1) for content in packer.drained() for _, row in content)
    if waiting:
        yield flushed()


def _pieces(tokenizer: str, words: bool, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, words)
        for piece in (p for b in batches for p in K.slices(b, "text")):
            raw, offsets = K.utf8(piece.column("text"))
            ids, sizes, starts = encode.encode(raw, offsets)
            bounds = token_bounds(sizes, starts, offsets)
            n = len(piece)
            whole = np.full(len(ids) + n, end_id, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            bounds = bounds + np.arange(n + 1)
            counts = -(-np.diff(bounds) // capacity)
            row, number = np.repeat(np.arange(n), counts), K.ranges(np.zeros(n, np.int64), counts)
            start = number * capacity
            low = bounds[row] + start
            high = np.minimum(low + capacity, bounds[row + 1])
            data = whole.tobytes()
            each = [data[4 * a:4 * b] for a, b in zip(low.tolist(), high.tolist())]
            columns = {
                "id": piece.column("doc_id").take(pa.array(row)), "piece": pa.array(number, pa.int32()), "start": start, "length": high - low,
                "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
            }
            yield pa.record_batch(columns | ({"ids": pa.array(each, pa.binary())} if with_ids else {}))

    return run


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
           fan_in: int = FAN_IN, words: bool = False, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids: little-endian unsigned 32-bit) of every piece.

    ``tokenizer``: file of the tokenizers library, readable by all executors. ``words``: it lower-cases, drops white
    space and ends pre-tokens where letters end, as ``WordChunkEncoder`` needs.
    """
    if capacity < 1 or open_bins < 1 or fan_in < 2:
        raise ValueError("capacity and open_bins are at least 1, fan_in at least 2")
    spark = docs.sparkSession
    schema = _PIECE + (", ids binary" if with_ids else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer, words, end_id, capacity, with_ids), schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, TaskContext.get().partitionId(), False, capacity, open_bins)

    def later(last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            whole = table.sort_by([("mix", "ascending"), ("start", "ascending"), ("length", "ascending")])
            return pa.Table.from_batches(_packed(iter(whole.select(columns).to_batches()), key[0].as_py(), last, capacity, open_bins))

        return run

    places = settled(pieces.mapInArrow(first, f"{schema}, {_PLACE}"), "op11-round0")
    number, closed = 0, None
    while True:
        # Sequences of round r, packer t, number k: distinct for up to 64 rounds and 2**25 packers.
        here = places.where("bin >= 0").withColumn("sequence_id", F.lit(number << 57) + F.col("bin"))
        closed = here if closed is None else closed.unionByName(here)
        rest = places.where("bin < 0")
        tokens = rest.agg(F.sum("length")).first()[0]
        if not tokens:
            return closed.select(F.col("id").alias("doc_id"), *columns[1:], "sequence_id", "offset")
        packers, number = -(-tokens // (fan_in * open_bins * capacity)), number + 1
        # Dealt and ordered by what a piece holds, so that a repeated task sees the same pieces in the same, mixed order.
        mixed = rest.select(*columns, F.xxhash64("id", "piece", "ids_crc32").alias("mix"))
        dealt = mixed.groupBy(F.pmod("mix", F.lit(packers)).alias("packer"))
        places = settled(dealt.applyInArrow(later(packers == 1), f"{schema}, {_PLACE}"), f"op11-round{number}")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence of ``packed(..., with_ids=True)``: sequence_id, n_tokens, ids, and docs (doc_id, piece, offset, length) for masks
    that keep attention inside a document. A group holds at most one capacity of tokens."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id", F.expr("aggregate(parts, 0L, (n, p) -> n + p.length)").alias("n_tokens"),
        F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"),
        F.expr("transform(parts, p -> struct(p.doc_id, p.piece, p.offset, p.length))").alias("docs"),
    )
