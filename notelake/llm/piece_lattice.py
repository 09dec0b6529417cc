"""N-best segmentation into SentencePiece pieces, and decoding.

A text, with a space in front and spaces as marks, is a lattice of the model's pieces; a path's score
is the sum of its pieces' scores. A forward Viterbi pass gives every place the score of its best
prefix. A backward search from the end then takes the paths in order: the score of the suffix found so
far plus the forward score of the place it starts at is exactly the score of the best path through it,
so A* with this heuristic opens nothing in vain (``Lattice.nbest``).

Pieces hold spaces only in front and never a line feed, so the lattice of a long text falls apart into
chunks there: a run of spaces and the word after it are one. Chunks are remembered by hash; new ones go through the forward
pass together, as arrays, keeping the two best scores per place. The n best paths of a text differ from
its best path in the n - 1 chunks of smallest loss at most, so only these are searched backwards.

A character that is no piece falls back to its bytes' pieces at ``UNKNOWN_LOSS`` below the lowest
score. So do pieces of spaces alone, one or several, whose scores only bar them: of a run of spaces the
fewest pieces are the best.

Defined results: null text counts as empty and is one piece, the space in front; equal scores come in
a fixed order, longer last pieces first; fewer than n rows where there are fewer paths; repeated rows
and missing ids do not matter; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

REMEMBERED = 1 << 19
UNKNOWN_LOSS = 10.0
# Chunks of more characters go through the forward pass one by one.
_LONG = 40
_BARRED = -1e8
_lattices: dict[str, Lattice] = {}


class Lattice:
    """The pieces of one model, and what is known about chunks."""

    def __init__(self, model: str):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=model)
        size = read.get_piece_size()
        self.pieces: dict[bytes, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [read.unk_id()] * 256
        for i in range(size):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
                self.byte_ids[self.bytes_of[i][0]] = i
            elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                if "▁" in piece.lstrip("▁") or "\n" in piece:
                    raise ValueError(f"a piece with a space or a line feed inside: {piece!r}")
                self.pieces[self.bytes_of[i]] = i, read.get_score(i)
        # Scores that only bar a piece (those of spaces alone have one) count as unknown characters do.
        self.unknown = min(s for _, s in self.pieces.values() if s > _BARRED) - UNKNOWN_LOSS
        self.pieces = {p: (i, max(s, self.unknown)) for p, (i, s) in self.pieces.items()}
        self.longest = max(len(p.decode()) for p in self.pieces)
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_starts = np.cumsum(self.sizes) - self.sizes
        raw, offsets = K.utf8(pa.array([p.decode() for p in self.pieces]))
        # As _forward hashes stretches of a text: by powers, which tell strings as short as pieces apart.
        hashes = K.Rolling(K.byte_codes(raw), K.BYTE_BASE).of(offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self._hashes = hashes[order]
        self._ids = np.array([i for i, _ in self.pieces.values()])[order]
        self._scores = np.array([s for _, s in self.pieces.values()])[order]
        self._known = np.zeros(1 << 20, bool)
        self._known[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.score, self.loss = np.zeros(1 << 14), np.zeros(1 << 14)
        self.paths: dict[bytes, list[tuple[float, list[int]]]] = {}

    # One chunk.

    def _arcs(self, chunk: bytes) -> tuple[list[int], list[list[tuple[int, tuple[int, ...], float]]]]:
        """Bytes where characters start (and the end), and per character end: (start, ids, score) of all pieces, longest first."""
        edges = [i for i, b in enumerate(chunk) if b & 0xC0 != 0x80] + [len(chunk)]
        ending: list[list[tuple[int, tuple[int, ...], float]]] = [[]]
        for j in range(1, len(edges)):
            here = []
            for i in range(max(0, j - self.longest), j):
                found = self.pieces.get(chunk[edges[i]:edges[j]])
                if found is not None:
                    here.append((i, (found[0],), found[1]))
            if not here or here[-1][0] != j - 1:
                here.append((j - 1, tuple(self.byte_ids[b] for b in chunk[edges[j - 1]:edges[j]]), self.unknown))
            ending.append(here)
        return edges, ending

    def nbest(self, chunk: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths, best first: (score, ids)."""
        _, ending = self._arcs(chunk)
        forward = [0.0]
        for here in ending[1:]:
            forward.append(max(forward[i] + s for i, _, s in here))
        end = len(ending) - 1
        # (-(suffix + forward), place, order of entry, suffix score, pieces after the place as a chain): of
        # equal paths the one that is furthest, or a long run of spaces opens all its equal paths at once.
        heap: list = [(-forward[end], end, 0, 0.0, None)]
        out: list[tuple[float, list[int]]] = []
        entered = 0
        while heap and len(out) < n:
            _, place, _, suffix, chain = heapq.heappop(heap)
            if place == 0:
                ids: list[int] = []
                while chain is not None:
                    ids.extend(chain[0])
                    chain = chain[1]
                out.append((suffix, ids))
                continue
            for i, piece, s in ending[place]:
                entered += 1
                heapq.heappush(heap, (-(suffix + s + forward[i]), i, entered, suffix + s, (piece, chain)))
        return out

    def _two_best(self, chunk: bytes) -> tuple[list[int], float, float]:
        best = self.nbest(chunk, 2)
        return best[0][1], best[0][0], best[0][0] - best[1][0] if len(best) > 1 else np.inf

    # Many chunks.

    def _forward(self, raw: np.ndarray, rolling: K.Rolling, heads: np.ndarray, first: np.ndarray, length: int) -> list[tuple[list[int], float, float]]:
        """(ids, score, loss of the second best path) of chunks with equally many characters."""
        n = len(first)
        edges = heads[first[:, None] + np.arange(length + 1)]
        best = np.full((n, length + 1), -np.inf)
        second = best.copy()
        best[:, 0] = 0.0
        back, used = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -1, np.int64)
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                score, ids = self._looked_up(rolling.of(edges[:, i], edges[:, j]), i == j - 1)
                one, two = best[:, i] + score, second[:, i] + score
                wins = one > best[:, j]
                second[:, j] = np.where(wins, np.maximum(best[:, j], two), np.maximum(second[:, j], one))
                best[wins, j], back[wins, j], used[wins, j] = one[wins], i, ids[wins]
        out = []
        lists = zip(back.tolist(), used.tolist(), edges.tolist(), best[:, -1].tolist(), (best[:, -1] - second[:, -1]).tolist())
        for back_row, used_row, edge_row, score, loss in lists:
            ids: list[int] = []
            j = length
            while j:
                i = back_row[j]
                if used_row[j] >= 0:
                    ids.append(used_row[j])
                else:
                    ids.extend(self.byte_ids[b] for b in raw[edge_row[i]:edge_row[j]][::-1].tolist())
                j = i
            out.append((ids[::-1], score, loss))
        return out

    def _looked_up(self, hashes: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
        score, ids = np.full(len(hashes), self.unknown if single else -np.inf), np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self._known[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self._hashes, hashes[maybe]), len(self._hashes) - 1)
        same = self._hashes[at] == hashes[maybe]
        score[maybe[same]], ids[maybe[same]] = self._scores[at[same]], self._ids[at[same]]
        return score, ids

    def learn(self, keys: list[int], raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Take in new chunks."""
        if len(self.index) > REMEMBERED:
            raise AssertionError("forget before learning")
        heads = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
        first = np.searchsorted(heads, starts)
        lengths = np.searchsorted(heads, ends) - first
        rolling = K.Rolling(K.byte_codes(raw), K.BYTE_BASE)
        found: list = [None] * len(keys)
        for length in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == length)
            if length > _LONG:
                for i in some:
                    found[i] = self._two_best(raw[starts[i]:ends[i]].tobytes())
                continue
            for i, result in zip(some.tolist(), self._forward(raw, rolling, heads, first[some], length)):
                found[i] = result
        n, used = len(self.index), int(self.starts[len(self.index)])
        total = used + sum(len(f[0]) for f in found)
        while n + len(keys) + 1 > len(self.starts):
            self.starts, self.score, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.score, self.loss))
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used:total] = np.concatenate([np.array(f[0], np.int32) for f in found])
        self.starts[n + 1:n + 1 + len(keys)] = used + np.cumsum([len(f[0]) for f in found])
        self.score[n:n + len(keys)] = [f[1] for f in found]
        self.loss[n:n + len(keys)] = [f[2] for f in found]
        self.index.update(zip(keys, range(n, n + len(keys))))

    def alternatives(self, chunk: bytes, n: int) -> list[tuple[float, list[int]]]:
        have = self.paths.get(chunk)
        if have is None or len(have) < n:
            have = self.nbest(chunk, n)
            if len(self.paths) < REMEMBERED // 16 and len(chunk) < 256:
                self.paths[chunk] = have
        return have[:n]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the pieces, without the space in front."""
        return self.flat_bytes[K.ranges(self.byte_starts[ids], self.sizes[ids])].tobytes()[1:]


def lattice(model: str) -> Lattice:
    if model not in _lattices:
        _lattices[model] = Lattice(model)
    return _lattices[model]


def _chunked(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with a space in front of each row, the rows' first bytes, and the chunks' first bytes."""
    n = len(offsets) - 1
    spaced = np.insert(raw, offsets[:-1], 0x20)
    rows = offsets + np.arange(n + 1)
    line, space = spaced == 0x0A, spaced == 0x20
    cut = space | line
    cut[1:] &= ~(space[1:] & space[:-1])
    cut[1:] |= line[:-1]
    cut[rows[:-1]] = True
    return spaced, rows, np.flatnonzero(cut)


def _best_sums(choices: list[list[tuple[float, list[int]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best ways to take one path of each list: (loss, places in the lists), least loss first."""
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for paths in choices:
        sums = sorted((loss + paths[0][0] - s, (*at, i)) for loss, at in sums for i, (s, _) in enumerate(paths))[:n]
    return sums


def segmented(texts: pa.Array, pieces: Lattice, n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
    """For each text its n best segmentations: (score, ids)."""
    raw, rows, starts = _chunked(*K.utf8(texts))
    ends = np.append(starts[1:], len(raw))
    distinct, first, inverse = np.unique(K.stretch_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    if len(pieces.index) > REMEMBERED:
        pieces._forget()
    keys = distinct.tolist()
    new = [i for i, h in enumerate(keys) if h not in pieces.index]
    if new:
        pieces.learn([keys[i] for i in new], raw, starts[first[new]], ends[first[new]])
    index = np.fromiter(map(pieces.index.__getitem__, keys), np.int64, len(keys))[inverse]
    begin, loss = pieces.starts[index], pieces.loss[index]
    sizes = pieces.starts[index + 1] - begin
    ids = pieces.flat[K.ranges(begin, sizes)]
    bounds = np.append(0, np.cumsum(sizes))
    scores = np.append(0.0, np.cumsum(pieces.score[index]))
    chunks = np.searchsorted(starts, rows)
    for low, high in zip(chunks[:-1].tolist(), chunks[1:].tolist()):
        best, score = ids[bounds[low]:bounds[high]], scores[high] - scores[low]
        out = [(score, best)]
        if n > 1:
            near = np.argsort(loss[low:high], kind="stable")[:n - 1] if high - low <= 4 * n else np.argpartition(loss[low:high], n - 2)[:n - 1]
            near = np.sort(near[np.isfinite(loss[low:high][near])]) + low
            paths = [pieces.alternatives(raw[starts[c]:ends[c]].tobytes(), n) for c in near]
            for less, at in _best_sums(paths, n)[1:]:
                parts, done = [], bounds[low]
                for c, choice, options in zip(near, at, paths):
                    if choice:
                        parts += [ids[done:bounds[c]], np.array(options[choice][1], np.int32)]
                        done = bounds[c + 1]
                parts.append(ids[done:bounds[high]])
                out.append((score - less, np.concatenate(parts)))
        yield out


def _encoded(model: str, n: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for piece in (p for b in batches for p in K.slices(b, "text")):
            row, rank, score, ids, decoded = [], [], [], [], []
            texts = piece.column("text").cast(pa.large_binary()).to_pylist() if digest else None
            for i, best in enumerate(segmented(piece.column("text"), pieces, n)):
                for k, (s, found) in enumerate(best):
                    row.append(i)
                    rank.append(k + 1)
                    score.append(s)
                    ids.append(found)
                    if digest:
                        decoded.append(pieces.decode(found) == texts[i])
            columns = {"doc_id": piece.column("doc_id").take(pa.array(row, pa.int64())), "rank": pa.array(rank, pa.int32()),
                       "score": pa.array(score, pa.float64()), "n_pieces": pa.array([len(x) for x in ids], pa.int64())}
            if digest:
                columns["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                columns["round_trip"] = pa.array(decoded, pa.bool_())
            else:
                columns["ids"] = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.record_batch(columns)

    return run


def nbest_encode(docs: DataFrame, model: str, n: int = 3, digest: bool = False) -> DataFrame:
    """doc_id, rank (1: best), score, n_pieces and ids of each document's n best segmentations. With ``digest``, ids_crc32 and
    round_trip (decoding gives the text) in place of ids. ``model``: file of the sentencepiece library, readable by all executors."""
    if n < 1:
        raise ValueError("n is at least 1")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    last = "ids_crc32 long, round_trip boolean" if digest else "ids array<int>"
    return rows.mapInArrow(_encoded(model, n, digest), f"doc_id long, rank int, score double, n_pieces long, {last}")


def _decoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for batch in batches:
            texts = [None if x.values is None else pieces.decode(x.values.to_numpy()).decode() for x in batch.column("ids")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "rank": batch.column("rank"), "text": pa.array(texts, pa.string())})

    return run


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """The texts of rows of ``nbest_encode``: doc_id, rank, text (null ids: null)."""
    return encoded.select("doc_id", "rank", "ids").mapInArrow(_decoded(model), "doc_id long, rank int, text string")
