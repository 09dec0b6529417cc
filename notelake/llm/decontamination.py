"""Benchmark decontamination: passages that could hold an item, decided on common subsequences.

1. Document frequencies of hashed words over all documents give weights: ``CONTENT`` for a word, 1 for
   one in over a tenth of the documents. Documents are counted by what follows the word, in ``FOLLOWERS``
   groups, and each group counts as the smallest does: a passage that many documents carry does not
   make its words frequent, since they are followed by the same words there. No word weighs nothing.
2. The benchmark comes in blocks of ``BLOCK`` items. Every document is read in passages of 64 words,
   one starting every 32, each with as many words on either side as the item has. The weight of the
   item's words in there is at least that of any common subsequence, so the passages where it reaches
   ``PARAPHRASE`` of the item's weight are all that step 3 could accept.
3. Candidates are decided on the longest common subsequence, its weight as a share of the item's. From
   ``VERBATIM`` on it is a leak; from ``PARAPHRASE`` on it is one if the item's answer (its last third,
   by weight) is there, too.

What is sent to executors is bounded: the weight table, and per block its words and items.

Defined results: null texts and items have no words and never match; repeated documents and items give
repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import row_key, settled, with_keys

PASSAGE, STRIDE = 64, 32
DF_BITS = 20
STOP_SHARE = 0.1
FOLLOWERS = 4
CONTENT = 4
# In the search, frequent words of up to this share of an item are taken as present.
GIVEN = 0.25
BLOCK = 256
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.5, 0.6
_ITEMS = "item long, words array<long>"
# Rows of word counts that leave a task at a time.
_SENT = 1 << 16


def _words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased letter-and-digit words, and each row's first word."""
    raw, offsets = K.utf8(piece.column("text"))
    raw = K.lowered(raw)
    starts, ends, rows = K.word_places(raw, offsets, K.NOT_ALNUM)
    return K.stretch_hashes(raw, starts, ends), rows


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the partition: documents per hashed word and group of the word after its first place (n0, n1, ...), a row for each word that occurs."""
    df = np.zeros(FOLLOWERS << DF_BITS, np.uint32)
    for piece in (p for b in batches for p in K.slices(b, "text")):
        words, rows = _words(piece)
        row = np.repeat(np.arange(len(piece)), np.diff(rows))
        _, first = np.unique((words >> np.uint64(64 - DF_BITS)).astype(np.int64) | row << DF_BITS, return_index=True)
        after = np.append(words[1:], np.uint64(0))
        after[rows[1:][np.diff(rows) > 0] - 1] = 0
        group = (after[first] % np.uint64(FOLLOWERS)).astype(np.int64)
        places, times = np.unique((words[first] >> np.uint64(64 - DF_BITS)).astype(np.int64) * FOLLOWERS + group, return_counts=True)
        df[places] += times.astype(np.uint32)
    df = df.reshape(-1, FOLLOWERS)
    held = np.flatnonzero(df.any(axis=1))
    for at in range(0, len(held), _SENT):
        some = held[at:at + _SENT]
        yield pa.record_batch({"word": some, **{f"n{i}": df[some, i].astype(np.int64) for i in range(FOLLOWERS)}})


def word_weights(docs: DataFrame) -> np.ndarray:
    """Weight per hashed word: 1 if over a tenth of the documents have it, whatever follows, else ``CONTENT``.

    Counts are rows until they are added up, so no task and not the driver holds those of several partitions.
    """
    groups = [f"n{i}" for i in range(FOLLOWERS)]
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_frequencies, "word long, " + ", ".join(f"{c} long" for c in groups))
    least = parts.groupBy("word").agg(F.least(*[F.sum(c) for c in groups]).alias("least"))
    # The driver gets the frequent words: of a document's distinct words ten times as many at the most.
    frequent = least.where(F.col("least") * FOLLOWERS > F.lit(float(max(STOP_SHARE * docs.count(), 2)))).select("word").toArrow()
    weights = np.full(1 << DF_BITS, CONTENT, np.uint8)
    weights[frequent.column("word").to_numpy()] = 1
    return weights


def _weights_of(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(words >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (p for b in batches for p in K.slices(b, "text")):
        words, rows = _words(piece)
        yield pa.record_batch({"item": piece.column("item"), "words": pa.ListArray.from_arrays(rows.astype(np.int32), pa.array(K.signed(words)))})


class Vocabulary:
    """The words a block of items is searched by, numbered."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self._known = np.zeros(1 << 20, bool)
        self._known[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def number(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for words of no item."""
        out = np.full(len(words), -1, np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self._known[(words >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, words[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == words[maybe]
            out[maybe[same]] = at[same]
        return out


def searched_by(items: list[np.ndarray], table: np.ndarray) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, its words' weights per item (words x items), and the weight a passage needs per item.

    An item is searched by its words but some frequent ones: these weigh ``GIVEN`` of the item at the most and are
    taken off what the passage needs, as if it had them all.
    """
    entries, need = [], np.zeros(len(items), np.float32)
    for j, words in enumerate(items):
        weights = _weights_of(words, table).astype(np.int64)
        distinct, place = np.unique(words, return_inverse=True)
        held = np.bincount(place, weights).astype(np.int64)
        frequent = np.flatnonzero(_weights_of(distinct, table) == 1)
        frequent = frequent[np.argsort(-held[frequent], kind="stable")]
        given = frequent[np.cumsum(held[frequent]) <= GIVEN * weights.sum()]
        entries.append(np.delete(distinct, given))
        need[j] = PARAPHRASE * weights.sum() - held[given].sum()
    hashes = np.unique(np.concatenate(entries))
    per_item = np.zeros((len(hashes), len(items)), np.float32)
    for j, words in enumerate(entries):
        per_item[np.searchsorted(hashes, words), j] = _weights_of(words, table)
    return Vocabulary(hashes), per_item, need


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, all of ``a`` at once in the bits of a number."""
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for word in b:
        hit = state & places.get(word, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _leak(share: float, answer: float) -> bool:
    return share >= VERBATIM or share >= PARAPHRASE and answer >= ANSWER


class Item:
    """What a passage is judged by."""

    def __init__(self, words: np.ndarray, table: np.ndarray):
        weights = _weights_of(words, table)
        # A word counts as often as it weighs, so that the longest common subsequence is the heaviest one.
        self.run = np.repeat(words, weights).tolist()
        self.weights = dict(zip(words.tolist(), weights.tolist()))
        self.counts = Counter(words.tolist())
        self.answer = set(words[-max(1, len(words) // 3):].tolist())
        self.answer_weight = sum(self.weights[w] for w in self.answer)
        self.norm = np.sqrt(sum((n * self.weights[w]) ** 2 for w, n in self.counts.items()))

    def judged(self, around: list) -> tuple[float, float] | None:
        """Share of the item's weight in common order, share of its answer's weight present; None if that is no leak."""
        own = [w for w in around if w in self.weights]
        there = Counter(own)
        answer = sum(self.weights[w] for w in self.answer if w in there) / self.answer_weight
        # A common subsequence has each word as often as both sides do at the most.
        most = sum(min(n, self.counts[w]) * self.weights[w] for w, n in there.items()) / len(self.run)
        if not _leak(most, answer):
            return None
        share = lcs_length(self.run, [w for w in own for _ in range(self.weights[w])]) / len(self.run)
        return (share, answer) if _leak(share, answer) else None

    def cosine(self, passage: np.ndarray, table: np.ndarray) -> float:
        words, times = np.unique(passage, return_counts=True)
        norm = np.sqrt(((times * _weights_of(words, table).astype(np.float64)) ** 2).sum())
        dot = sum(n * self.counts.get(w, 0) * self.weights.get(w, 0) ** 2 for w, n in zip(words.tolist(), times.tolist()))
        return float(dot / (norm * self.norm))


def _search(shared):
    """Candidates and their judgement for all documents (rows: doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vocabulary, per_item, need, words_of = shared.value
        items = [Item(words, table) for words in words_of]
        reach = np.array([len(words) for words in words_of])
        # Passages and their surroundings in blocks of STRIDE words: a passage is two blocks.
        sides = -(-reach // STRIDE)
        alike = [(int(side), np.flatnonzero(sides == side)) for side in np.unique(sides)]
        for piece in (p for b in batches for p in K.slices(b, "text")):
            words, rows = _words(piece)
            out: dict[tuple[int, int], tuple[float, float, float]] = {}
            sizes = np.diff(rows)
            blocks = -(-sizes // STRIDE)
            first = np.append(0, np.cumsum(blocks))
            each = np.where(sizes > 0, np.maximum(1, blocks - 1), 0)
            row = np.repeat(np.arange(len(piece)), each)
            block = K.ranges(first[:-1], each)
            number = vocabulary.number(words)
            places = np.flatnonzero(number >= 0)
            owner = np.searchsorted(rows, places, "right") - 1
            held_by = first[owner] + (places - rows[owner]) // STRIDE
            for at in range(0, len(block), 1024):
                some, of = block[at:at + 1024], row[at:at + 1024]
                low, high = max(0, some[0] - sides.max()), min(first[-1], some[-1] + 2 + sides.max())
                a, b = np.searchsorted(held_by, [low, high])
                if a == b:
                    continue
                # sums[k]: weight per item before block low + k.
                sums = np.zeros((high - low + 1, len(items)), np.float32)
                heads = np.flatnonzero(np.append(True, held_by[a + 1:b] != held_by[a:b - 1]))
                sums[held_by[a:b][heads] - low + 1] = np.add.reduceat(per_item[number[places[a:b]]], heads, axis=0)
                np.cumsum(sums, axis=0, out=sums)
                for side, same in alike:
                    start, stop = np.maximum(some - side, first[of]) - low, np.minimum(some + 2 + side, first[of + 1]) - low
                    enough = sums[np.ix_(stop, same)] - sums[np.ix_(start, same)] >= need[same]
                    for i, k in zip(*np.nonzero(enough)):
                        r, j = int(of[i]), int(same[k])
                        begin = rows[r] + (some[i] - first[r]) * STRIDE
                        end = min(begin + PASSAGE, rows[r + 1])
                        around = words[max(rows[r], begin - reach[j]):min(rows[r + 1], end + reach[j])]
                        leak = items[j].judged(around.tolist())
                        if leak is not None:
                            have = out.get((r, j), (0.0, 0.0, 0.0))
                            out[r, j] = max(have, (*leak, items[j].cosine(words[begin:end], table)))
            found = list(out)
            yield pa.record_batch({
                "doc_id": piece.column("doc_id").take(pa.array([r for r, _ in found], pa.int64())), "key": piece.column("key").take(pa.array([r for r, _ in found], pa.int64())),
                "item": pa.array([j for _, j in found], pa.int64()),
                **{n: pa.array([out[f][k] for f in found], pa.float64()) for k, n in enumerate(("lcs_share", "answer_share", "cosine"))}})

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, lcs_share, answer_share, cosine): benchmark items found in documents. key: xxhash64(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), text)
    table = word_weights(rows)
    blocks = max(1, -(-benchmark.count() // BLOCK) * 5 // 4)  # by hash, so with room to spare
    asked = benchmark.select(F.col("item_id").cast("long").alias("item"), text)
    asked = asked.mapInArrow(_item_words, _ITEMS).where(F.size("words") > 0)
    asked = settled(asked.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))), "op6-items")
    found = None
    for block in range(blocks):
        part = asked.where(F.col("block") == block).drop("block")
        held = part.orderBy("item", F.xxhash64("words")).toArrow()
        ids = held.column("item").to_pylist()
        items = [np.array(x, np.int64).view(np.uint64) for x in held.column("words").to_pylist()]
        if not items:
            continue
        shared = spark.sparkContext.broadcast((table, *searched_by(items, table), items))
        hits = rows.mapInArrow(_search(shared), "doc_id long, key long, item long, lcs_share double, answer_share double, cosine double")
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")  # at most a block
        hits = settled(hits.join(F.broadcast(names), "item").drop("item"), "op6-hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return rows.where("false").select("doc_id", "key", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("item_id", "long"), ("lcs_share", "double"), ("answer_share", "double"), ("cosine", "double"))])
    return found.select("doc_id", "key", "item_id", "lcs_share", "answer_share", "cosine")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns."""
    return with_keys(docs, leaks(docs, benchmark), "left_anti").select(*docs.columns)
