"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word's vector holds how often each letter occurs in it (a-z one dimension each, the other letters share
six). An edit of one code point adds one to at most one dimension and takes one from at most one other, so near
words have vectors at an L1 distance of two at most: one up and one down between words of equal length, one up
from a word to one that is a letter longer. Each length has a tree of its own, and each pair of lengths is a range search.

The upper part of the trees deals the words to cells. It is fitted on a sample of at most
``SAMPLE`` words, which decides how even cells are and nothing else: each word goes home to the cell of its vector, and
as a question to every cell, of its own length and of the next, whose box is in range. A cell that no count
can split is split by hash, and questions go to all its parts. In its cell a tree is built down to a few
words, the questions go down all together, boxes out of range are pruned, and what is left is compared letter by letter.
A leaf of very many words with one vector is not compared pair by pair, but by hashes of the
words with one letter left out, and then letter by letter.

Each pair is found once per direction. A cell gives one row per word (count, best neighbour), never its pairs.
Forms lead to words at least ``RATIO`` times as frequent, so a chain has as many steps as the largest count has digits,
and following them by doubling takes the logarithm of that in rounds.

Defined results: null and empty texts have no words; a null doc_id counts as an empty number in the noise rule, repeated rows
count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import settled

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words of the sample that the upper trees are fitted on, at most about.
SAMPLE = 1 << 18
CELL_WORDS = 1 << 14
LEAF_WORDS = 96
#: Words of a leaf that are compared pair by pair.
PAIRWISE = 512
REMEMBERED = 1 << 18

DIMENSIONS = 32
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[0xC0:] = 26 + np.arange(64) % 6

_COUNTS = "word string, n long"
_DEALT = "length int, cell int, part int, role int, word string, n long"
_NEAR = "word string, n_near long, best_n long, best string"
#: Roles in a cell: at home (asked and asking), asking from another cell, asking from the words one letter shorter.
HOME, SAME, SHORTER = 0, 1, 2


# Words of documents ---------------------------------------------------------------------------------


def _words(min_length: int, every: int | None):
    """Words of so many code points and how often a task saw them; one in ``every`` runs of a document loses a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for piece in (p for b in batches for p in K.slices(b, "text")):
            raw, offsets = K.utf8(piece.column("text"))
            raw = K.lowered(raw)
            latin = raw == 0xC3  # U+00C0 to U+00FF are this byte and one more
            inside = (raw >= 97) & (raw <= 122) | latin
            inside[1:] |= latin[:-1]
            starts, ends, rows = K.runs(inside, offsets)
            wide = np.append(0, np.cumsum(latin))
            long = ends - starts - (wide[ends] - wide[starts]) >= min_length
            owner = np.searchsorted(rows, np.flatnonzero(long), "right") - 1
            data = raw.tobytes()
            words = [data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            if every:
                heads = [zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in piece.column("doc_id").to_pylist()]
                for at, (word, row) in enumerate(zip(words, owner.tolist())):
                    h = zlib.crc32(word, heads[row])
                    if h % every == 0:
                        letters = word.decode()
                        k = h % len(letters)
                        words[at] = (letters[:k] + letters[k + 1:]).encode() if len(letters) > min_length else b""
            seen.update(words)
            if len(seen) > REMEMBERED:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    return run


def _counted(seen: Counter) -> pa.RecordBatch:
    seen.pop(b"", None)
    return pa.record_batch({"word": pa.array(list(seen), pa.binary()).cast(pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z in lower case, of so many code points and occurrences.

    ``noise_every``: a run whose crc32 of ``<doc_id>:<run>`` this divides loses its code point number crc32 modulo length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_words(min_length, noise_every), _COUNTS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# Vectors and trees -----------------------------------------------------------------------------------


def letters_of(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each (all are below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors_of(letters: np.ndarray) -> np.ndarray:
    n, length = letters.shape
    places = _DIMENSION[letters] + np.arange(n)[:, None] * DIMENSIONS
    counts = np.bincount(places.ravel(), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    return counts.astype(np.int16 if length < 1 << 15 else np.int32)


def _split(vectors: np.ndarray) -> tuple[int, int] | None:
    """The dimension and the count (left: up to it) that halve the vectors best; None if all are equal."""
    best = None
    for d in range(DIMENSIONS):
        column = vectors[:, d]
        low, high = int(column.min()), int(column.max())
        if low == high:
            continue
        middle = int(np.partition(column, len(column) // 2)[len(column) // 2])
        for cut in (max(middle - 1, low), min(middle, high - 1)):
            uneven = abs(2 * int(np.count_nonzero(column <= cut)) - len(column))
            if best is None or uneven < best[0]:
                best = uneven, d, cut
    return best and best[1:]


class Tree:
    """Splits of letter counts. Node i: dimension, cut, children; a leaf has dimension -1 and its number in place of the cut."""

    def __init__(self, vectors: np.ndarray, leaf_words: float):
        self.nodes: list[list[int]] = []
        self.members: list[np.ndarray] = []
        waiting = [(np.arange(len(vectors)), None, 0)]
        while waiting:
            some, parent, side = waiting.pop()
            if parent is not None:
                self.nodes[parent][side] = len(self.nodes)
            split = _split(vectors[some]) if len(some) > leaf_words else None
            if split is None:
                self.nodes.append([-1, len(self.members), 0, 0])
                self.members.append(some)
                continue
            d, cut = split
            low = vectors[some, d] <= cut
            here = len(self.nodes)
            self.nodes.append([d, cut, 0, 0])
            waiting += [(some[low], here, 2), (some[~low], here, 3)]

    def reached(self, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each leaf whose box some vectors can reach by ``up`` steps up and ``down`` steps down: those vectors."""
        n = len(vectors)
        waiting = [(0, np.arange(n), np.full(n, up, np.int8), np.full(n, down, np.int8))]
        while waiting:
            node, some, ups, downs = waiting.pop()
            d, cut, left, right = self.nodes[node]
            if d < 0:
                yield cut, some
                continue
            count = vectors[some, d]
            # Steps to the other side of the cut. A step in one dimension was never paid for before: a cut further
            # on in the same direction is out of reach, and one on the way back is free.
            need_down, need_up = np.maximum(count - cut, 0), np.maximum(cut + 1 - count, 0)
            for child, need, low in ((left, need_down, True), (right, need_up, False)):
                go = need <= (downs if low else ups)
                if go.any():
                    spent = need[go].astype(np.int8)
                    waiting.append((child, some[go], ups[go] - (0 if low else spent), downs[go] - (spent if low else 0)))


def fitted(sample: list[str], share: float, cell_words: int) -> dict[int, tuple[Tree, list[int]]]:
    """A tree per length that has too many words for one cell, and how many parts each cell has."""
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    forest = {}
    for length, words in by_length.items():
        if len(words) > share * cell_words:
            tree = Tree(vectors_of(letters_of(words)), max(share * cell_words, 1))
            parts = [max(1, math.ceil(len(m) / (4 * max(share * cell_words, 1)))) for m in tree.members]
            tree.members = []
            forest[length] = tree, parts
    return forest


# Dealing words to cells --------------------------------------------------------------------------------


def _dealt(forest: dict[int, tuple[Tree, list[int]]]):
    def questions(length: int, vectors: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, cell and part of each question to the words of this length."""
        if length not in forest:
            n = len(vectors)
            return np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        tree, parts = forest[length]
        found = [(some, cell, part) for cell, some in tree.reached(vectors, up, down) for part in range(parts[cell])]
        word = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        return word, np.repeat([f[1] for f in found], [len(f[0]) for f in found]), np.repeat([f[2] for f in found], [len(f[0]) for f in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column("word")).to_numpy()
            for length in np.unique(lengths).tolist():
                some = batch.take(pa.array(np.flatnonzero(lengths == length)))
                words = some.column("word")
                vectors = vectors_of(letters_of(words.to_pylist()))
                hashes = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.int64)
                out = [(length, HOME, *questions(length, vectors, 0, 0)), (length, SAME, *questions(length, vectors, 1, 1)),
                       (length + 1, SHORTER, *questions(length + 1, vectors, 1, 0))]
                # At home a word is in one part only; there it asks as well, so the question is not sent twice.
                at, cell, part = out[0][2:]
                parts = np.array([forest[length][1][c] for c in cell.tolist()]) if length in forest else np.ones(len(cell), np.int64)
                mine = part == hashes[at] % parts
                home = {"at": at[mine], "cell": cell[mine], "part": part[mine]}
                key = np.zeros((len(words), 2), np.int64)
                key[home["at"]] = np.stack([home["cell"], home["part"]], 1)
                yield _deal(some, length, HOME, home["at"], home["cell"], home["part"])
                at, cell, part = out[1][2:]
                away = (key[at, 0] != cell) | (key[at, 1] != part)
                yield _deal(some, length, SAME, at[away], cell[away], part[away])
                yield _deal(some, length + 1, SHORTER, *out[2][2:])

    return run


def _deal(rows: pa.RecordBatch, length: int, role: int, at: np.ndarray, cell: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    n, take = len(at), pa.array(at, pa.int64())
    return pa.record_batch({
        "length": np.full(n, length, np.int32), "cell": np.asarray(cell, np.int32), "part": np.asarray(part, np.int32), "role": np.full(n, role, np.int32),
        "word": rows.column("word").take(take), "n": rows.column("n").take(take)})


# Inside a cell -----------------------------------------------------------------------------------------


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ in exactly one place."""
    return np.count_nonzero(a != b, axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` are those of ``short`` with one letter more."""
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= short.shape[1]


_codes = np.random.default_rng(8).integers(0, 1 << 62, (512, 256), dtype=np.int64)


def _left_out(letters: np.ndarray, closed: bool) -> Iterator[np.ndarray]:
    """Per place: hashes of the words without the letter there; ``closed``: the letters behind it move up."""
    n, length = letters.shape
    code = lambda places, columns: _codes[places % 512, letters[:, columns]] * (2 * (places // 512) + 1)
    places = np.arange(length)
    here = code(places, places)
    total = here.sum(axis=1)
    if not closed:
        for p in range(length):
            yield total - here[:, p]
        return
    front = np.zeros((n, length + 1), np.int64)
    np.cumsum(here, axis=1, out=front[:, 1:])
    moved = np.zeros((n, length + 1), np.int64)
    moved[:, 1:-1] = np.cumsum(code(places[:-1], places[1:])[:, ::-1], axis=1)[:, ::-1][:, :length - 1] if length > 1 else 0
    for p in range(length):
        yield front[:, p] + moved[:, p + 1]


def _equal_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a[i] == b[j]."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    return np.repeat(np.arange(len(a)), high - low), order[K.ranges(low, high - low)]


def _by_hashes(mine: np.ndarray, theirs: np.ndarray, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs between words with nearly equal vectors, without comparing all of them."""
    if shorter:
        # The longer word without one letter is the shorter one.
        total = _codes[np.arange(mine.shape[1]) % 512, mine] * (2 * (np.arange(mine.shape[1]) // 512) + 1)
        found = [_equal_pairs(total.sum(axis=1), h) for h in _left_out(theirs, True)]
    else:
        found = [_equal_pairs(a, b) for a, b in zip(_left_out(mine, False), _left_out(theirs, False))]
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    both = np.unique(i * len(theirs) + j)
    return both // len(theirs), both % len(theirs)


def _unary(vectors: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as rows of ones, so that a product of two rows is the number of letters that the words share."""
    steps = np.arange(1, int(most.max(initial=0)) + 1)
    used = (steps[None] <= most[:, None]).ravel()
    return (vectors[:, :, None] >= steps).reshape(len(vectors), -1)[:, used].astype(np.float32)


def near_pairs(mine: np.ndarray, theirs: np.ndarray, shorter: bool, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): letters mine[i] and theirs[j] are one edit apart; ``mine`` are one letter shorter, or as long."""
    none = np.zeros(0, np.int64)
    if not len(mine) or not len(theirs):
        return none, none
    asking, asked = vectors_of(mine), vectors_of(theirs)
    tree = tree or Tree(asked, LEAF_WORDS)
    up, down = (1, 0) if shorter else (1, 1)
    verify = one_inserted if shorter else one_replaced
    # All but one letter of the longer word are shared: an L1 distance of one, or of one up and one down.
    shared = theirs.shape[1] - 1
    # Letters beyond these counts would only make the rows longer; words that share them all are in range still.
    most = np.minimum(asked.max(axis=0), 64)
    capped = bool((asked.max(axis=0) > 64).any())
    out = []
    for leaf, some in tree.reached(asking, up, down):
        members = tree.members[leaf]
        if len(members) > PAIRWISE:
            i, j = _by_hashes(mine[some], theirs[members], shorter)
            pairs = some[i], members[j]
        else:
            pairs = _in_range(asking, asked, some, members, most, shared, capped)
        for k in range(0, len(pairs[0]), 1 << 16):
            i, j = pairs[0][k:k + (1 << 16)], pairs[1][k:k + (1 << 16)]
            close = verify(mine[i], theirs[j])
            out.append((i[close], j[close]))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (none, none)


def _in_range(asking: np.ndarray, asked: np.ndarray, some: np.ndarray, members: np.ndarray, most: np.ndarray, shared: int, capped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``some`` and the leaf's ``members`` that share so many letters."""
    leaf = asked[members]
    most = np.minimum(most, leaf.max(axis=0))
    theirs = _unary(leaf, most)
    least = shared - np.maximum(leaf - most, 0).sum(axis=1) if capped else shared
    out = []
    for k in range(0, len(some), 1 << 14):
        part = some[k:k + (1 << 14)]
        i, j = np.nonzero(_unary(asking[part], most) @ theirs.T >= least)
        out.append((part[i], members[j]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _near_in_cell(table: pa.Table) -> pa.Table:
    roles, n = table.column("role").to_numpy(), table.column("n").to_numpy()
    words = table.column("word").combine_chunks()
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    home, same, shorter = np.flatnonzero(roles == HOME), np.flatnonzero(roles <= SAME), np.flatnonzero(roles == SHORTER)
    found = []
    if len(home):
        asked = letters_of(words.take(pa.array(home)).to_pylist())
        tree = Tree(vectors_of(asked), LEAF_WORDS)
        i, j = near_pairs(letters_of(words.take(pa.array(same)).to_pylist()), asked, False, tree)
        found.append((same[i], home[j]))
        if len(shorter) and asked.shape[1] > 1:
            i, j = near_pairs(letters_of(words.take(pa.array(shorter)).to_pylist()), asked, True, tree)
            found += [(shorter[i], home[j]), (home[j], shorter[i])]
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    each, first, count = np.unique(i, return_index=True, return_counts=True)
    return pa.table({"word": words.take(pa.array(each)), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[j[first]], pa.int64()),
                     "best": words.take(pa.array(j[first]))})


# The whole ----------------------------------------------------------------------------------------------


def near_words(counts: DataFrame, sample: int = SAMPLE, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of each word that has near ones: how many, and the most frequent (ties: the first in code-point order).

    ``counts``: (word, n), words distinct and of Latin letters up to U+00FF.
    """
    total = counts.count()
    share = min(1.0, sample / max(total, 1))
    # Fitted on a share of the words picked by hash; decides the sizes of cells only.
    some = counts.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("word").limit(2 * sample)
    forest = fitted([r["word"] for r in some.toLocalIterator()] if total > cell_words else [], share, cell_words)
    dealt = counts.mapInArrow(_dealt(forest), _DEALT)
    near = dealt.groupBy("length", "cell", "part").applyInArrow(_near_in_cell, _NEAR)
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("first")).select(
        "word", "n_near", (-F.col("first.col1")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end. Links lead to more frequent words, so they end; their lengths halve each round."""
    links, number = settled(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "op12-links"), 0
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = links.select("word", "root").join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        number += 1
        links = settled(longer, f"op12-links{number}", links)
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def spelling_groups(counts: DataFrame, ratio: int = RATIO, sample: int = SAMPLE, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each counted word (word, n).

    The form is the near word of the largest n (ties: the first in code-point order) if that is at least ``ratio`` times the word's.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    counts = settled(counts.select("word", "n"), "op12-counts")
    near = settled(near_words(counts, sample, cell_words), "op12-near")
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = settled(counts.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")),
        "op12-rows", near)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
