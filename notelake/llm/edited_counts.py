"""Token counts that follow edits.

A document is a segment tree over its chunks (see ``chunks``): leaves hold a chunk's tokens, inner
nodes their sums. An edit replaces a stretch of the text. A chunk ends where the three bytes before a
blank say so, hence an edit can only change the chunks it touches, the one before it and those that
start within three bytes after it. Just these are encoded again; their leaves give way to one leaf for
the new region, and only the sums on the paths above change. The text around is never read again.

Edits come as a column of (start, length, replacement), in code points of the text as it is before
all edits; they must not overlap and are applied from the last to the first.

Defined results: null text counts as empty, a null or empty list changes nothing, a null replacement
deletes; a start or an end beyond the text is drawn to its end; overlapping edits raise an error;
rows are counted one by one, so repeated rows, ties and missing ids do not matter; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .chunks import ChunkEncoder, encoder, texts_of

_LOOK_BACK = 3
_COUNTS = "doc_id long, n_tokens long, n_tokens_edited long, n_chunks long, n_encoded_again long"


class ChunkTree:
    """Sums of tokens over the chunks of one text."""

    def __init__(self, tokens: np.ndarray):
        size = 1
        while size < len(tokens):
            size *= 2
        level = np.zeros(size, np.int64)
        level[:len(tokens)] = tokens
        self.levels = [level.tolist()]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            self.levels.append(level.tolist())

    @property
    def total(self) -> int:
        return self.levels[-1][0]

    def replace(self, first: int, stop: int, tokens: int) -> None:
        """The leaves ``first`` to ``stop`` - 1 give way to one with ``tokens``; sums above them are made anew, path by path."""
        for i in range(first, stop):
            self.levels[0][i] = 0
        self.levels[0][first] = tokens
        low, high = first, max(first, stop - 1)
        for below, above in zip(self.levels, self.levels[1:]):
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                above[i] = below[2 * i] + below[2 * i + 1]


def edited_total(text: bytes, starts: list[int], tree: ChunkTree, edits: list[tuple[int, int, bytes]], encode: ChunkEncoder) -> tuple[int, int]:
    """Tokens after the edits (byte start, byte end, replacement; ascending, apart), and chunks encoded again."""
    again = 0
    if not starts:
        starts, ends = [0], [0]
    ends = [*starts[1:], len(text)]
    # Edits whose regions meet are one region.
    regions: list[tuple[int, int, list[tuple[int, int, bytes]]]] = []
    for a, b, new in edits:
        first = max(0, bisect_left(starts, a) - 1)
        # The first chunk whose start and the bytes that made it one lie behind the edit.
        stop = max(first + 1, bisect_left(starts, b + _LOOK_BACK + 1))
        if regions and first <= regions[-1][1]:
            regions[-1] = regions[-1][0], max(stop, regions[-1][1]), [*regions[-1][2], (a, b, new)]
        else:
            regions.append((first, stop, [(a, b, new)]))
    for first, stop, inside in regions:
        at, pieces = starts[first], []
        for a, b, new in inside:
            pieces += [text[at:a], new]
            at = b
        pieces.append(text[at:ends[stop - 1]])
        _, sizes, _ = encode.encode(*texts_of([b"".join(pieces).decode()]), counts_only=True)
        again += len(sizes)
        tree.replace(first, stop, int(sizes.sum()))
    return tree.total, again


def _byte_edits(text: str, edits: list[dict] | None) -> list[tuple[int, int, bytes]]:
    """Code points to bytes; ascending; checked."""
    out: list[tuple[int, int, bytes]] = []
    n = len(text)
    spans = [(min(max(e["start"] or 0, 0), n), e["length"] or 0, e["replacement"] or "") for e in edits or [] if e is not None]
    spans.sort(key=lambda e: e[0])
    at_char = at_byte = 0
    for start, length, new in spans:
        stop = min(start + max(length, 0), n)
        if start < at_char:
            raise ValueError("edits overlap")
        a = at_byte + len(text[at_char:start].encode())
        b = a + len(text[start:stop].encode())
        out.append((a, b, new.encode()))
        at_char, at_byte = stop, b
    return out


def _counted(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for piece in (p for b in batches for p in K.slices(b, "text")):
            raw, offsets = K.utf8(piece.column("text"))
            _, sizes, starts = encode.encode(raw, offsets, counts_only=True)
            rows = np.searchsorted(starts, offsets)
            texts, edits = piece.column("text").to_pylist(), piece.column("edits").to_pylist()
            out = np.zeros((4, len(piece)), np.int64)
            for i, (low, high) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                tree = ChunkTree(sizes[low:high])
                before = tree.total
                changes = _byte_edits(texts[i], edits[i])
                after, again = before, 0
                if changes:
                    after, again = edited_total(raw[offsets[i]:offsets[i + 1]].tobytes(), (starts[low:high] - offsets[i]).tolist(), tree, changes, encode)
                out[:, i] = before, after, high - low, again
            yield pa.record_batch({"doc_id": piece.column("doc_id"), **dict(zip(("n_tokens", "n_tokens_edited", "n_chunks", "n_encoded_again"), out))})

    return run


def edited_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, edits: array<struct<start int, length int, replacement string>>): doc_id, n_tokens,
    n_tokens_edited, n_chunks, and n_encoded_again, the chunks that the edits made encode again."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"),
                       F.col("edits").cast("array<struct<start:int,length:int,replacement:string>>").alias("edits"))
    return rows.mapInArrow(_counted(tokenizer), _COUNTS)
