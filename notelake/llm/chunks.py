"""Byte-level BPE over distinct chunks: what a text repeats is encoded once.

A chunk starts before a space or line feed that follows something other than white space. The
tokenizer's own pre-tokens never cross such a place, nor do they look past the end of a chunk, so the
ids of a text are those of its chunks, one after the other.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Chunks a worker remembers before it starts anew.
REMEMBERED = 1 << 20
_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every chunk of all rows; rows without text have none."""
    cut = np.zeros(len(raw), bool)
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    blank = np.flatnonzero((raw[1:] == 0x20) | (raw[1:] == 0x0A)) + 1
    before = raw[blank - 1]
    solid = (before > 0x20) & (before < 0x7F)
    # After a letter of several bytes, unless it may be one of Unicode's white spaces.
    wide = np.flatnonzero(before >= 0x80)
    at = blank[wide]
    second, third = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    solid[wide] = (second != 0xC2) & ~np.isin(third, (0xE1, 0xE2, 0xE3))
    cut[blank[solid]] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Ids of chunks, remembered by their bytes in one flat array; hashes only find the distinct chunks of a slice."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._flat = np.zeros(1 << 16, np.uint32)
        self._starts, self._used = np.zeros(1 << 14, np.int64), 0

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, the first of every chunk, and the first of it that counts."""
        starts = chunk_starts(raw, offsets)
        return raw, starts, starts

    @property
    def vocabulary(self) -> int:
        return self._tokenizer.get_vocab_size()

    def _learn(self, chunks: list[bytes]) -> None:
        for chunk, encoding in zip(chunks, self._tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)):
            ids = encoding.ids
            n = len(self._index)
            if n + 2 > len(self._starts):
                self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
            while self._used + len(ids) > len(self._flat):
                self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
            self._flat[self._used:self._used + len(ids)] = ids
            self._used += len(ids)
            self._index[chunk] = n
            self._starts[n + 1] = self._used

    def encode(self, raw: np.ndarray, offsets: np.ndarray, counts_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows (or nothing), tokens per chunk, and first byte of each chunk."""
        raw, starts, begins = self._cut(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        _, first, inverse = np.unique(K.stretch_hashes(raw, begins, ends), return_index=True, return_inverse=True)
        if len(self._index) > REMEMBERED:
            self._forget()
        data = raw.tobytes()
        keys = [data[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist())]
        if not K.same_stretches(raw, begins, ends, first[inverse]):
            # Two chunks of one hash: take every chunk by its bytes.
            keys, inverse = [data[a:b] for a, b in zip(begins.tolist(), ends.tolist())], np.arange(len(starts))
        new = [c for c in dict.fromkeys(keys) if c not in self._index]
        if new:
            self._learn(new)
        index = np.fromiter(map(self._index.__getitem__, keys), np.int64, len(keys))[inverse]
        begin = self._starts[index]
        sizes = self._starts[index + 1] - begin
        return (self._flat[:0] if counts_only else self._flat[K.ranges(begin, sizes)]), sizes, starts


class WordChunkEncoder(ChunkEncoder):
    """For a tokenizer that lower-cases, drops white space and ends pre-tokens where letters begin or end.

    Chunks end there too (at ASCII and Latin-1 letters, and never after an apostrophe, which may belong to the
    letters behind it), and A-Z are lower-cased before, so far fewer chunks are distinct.
    """

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = chunk_starts(raw, offsets)
        data = raw.tobytes()
        if len(raw) < 2 or any(t.encode() in data for t in self._special):
            return raw, starts, starts
        # Letters that a combining mark follows are left to the tokenizer, which composes before it lower-cases.
        marked = np.zeros(len(raw), bool)
        marked[:-1] = np.isin(raw[1:], (0xCC, 0xCD))
        raw = np.where(marked, raw, K.lowered(raw))
        wide = np.zeros(len(raw), bool)  # second byte of a Latin-1 letter
        wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        small = (raw >= 97) & (raw <= 122)
        first = small.copy()
        first[:-1] |= wide[1:]
        other = (raw > 32) & (raw < 127) & ~small & ~((raw >= 65) & (raw <= 90))
        cut = np.zeros(len(raw), bool)
        cut[starts] = True
        cut[1:] |= (small | wide)[:-1] & other[1:] | (other & (raw != 39))[:-1] & first[1:]
        starts = np.flatnonzero(cut)
        return raw, starts, starts + ((raw[starts] == 0x20) | (raw[starts] == 0x0A))

    @property
    def _special(self) -> list[str]:
        return [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]


def encoder(path: str, words: bool = False) -> ChunkEncoder:
    """The worker's encoder for this tokenizer file. ``words``: the tokenizer is as ``WordChunkEncoder`` says."""
    if (path, words) not in _encoders:
        _encoders[path, words] = (WordChunkEncoder if words else ChunkEncoder)(path)
    return _encoders[path, words]


def token_bounds(sizes: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First token of each row, from tokens per chunk and the chunks' first bytes."""
    return np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]


def texts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return K.utf8(pa.array(texts, pa.string()))
