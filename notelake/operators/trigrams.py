"""Inverted index of trigrams for keyword search: which entries hold a keyword, without asking each entry for each.

A keyword can only be in a haystack that holds all of the keyword's trigrams, so it is looked up under its rarest
one and then checked by substring. A query that needs m of n keywords is looked up under its n - m + 1
rarest only (repeats counted), since an entry that lacks all of those cannot have m. Words that every entry
holds therefore cost nothing, and no query is ever paired with an entry that holds none of its rare words.

Three forms, with the same rows:

* ``matched_in_scan``: a small batch of queries is shipped and the entries are read once. Each slice of entries
  has an index of its own, so rarest means rarest in the slice. Nothing is shuffled.
* ``matched_by_postings``: posting lists of the entries meet the queries' rare trigrams by shuffle. Lists are split by
  blocks of entries, so no trigram, however common, makes a list of more than ``block_rows`` ids.
* a stored index (``sources/keyword_index.py``) keeps the posting lists with the table.

A trigram is three code points of the haystack in one BIGINT, exact, 21 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import GROUP_KEYS
from ..session import materialize, spread_small
from .blocks import BLOCK_ROWS, block_of, plan_blocks, with_block_counts

GRAM = 3
_BITS = 21
# Code points looked at together; a longer text is taken in overlapping windows.
_WINDOW = 1 << 20
# Entries of one index in a scan, and their code points.
_SLICE_ROWS, _SLICE_POINTS = 8192, 1 << 23
# Pairs held at once while matches are counted.
_PAIRS = 1 << 20
_FILTER_BITS = 22
# Trigrams asked for are shipped up to this number; beyond it, entries list all of theirs.
MAX_SHIPPED_GRAMS = 2_000_000

_ON = list(GROUP_KEYS)
_GROUP_DDL = "role string, category string"


def _codes(points: np.ndarray) -> np.ndarray:
    wide = points.astype(np.int64)
    return wide[:-2] | wide[1:-1] << _BITS | wide[2:] << 2 * _BITS


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Wanted:
    """A set of trigrams (sorted, distinct codes), behind a table of bits that most others fail."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self._maybe = np.zeros(1 << _FILTER_BITS, bool)
        self._maybe[_slot(codes)] = True

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` are wanted, and their numbers in the set."""
        at = np.flatnonzero(self._maybe[_slot(codes)])
        number = np.searchsorted(self.codes, codes[at])
        found = np.zeros(len(at), bool)
        inside = number < len(self.codes)
        found[inside] = self.codes[number[inside]] == codes[at[inside]]
        return at[found], number[found]


def grams_of(texts: Sequence[str], wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, trigram) pairs, by text; the trigram as its number in ``wanted``, else as its code."""
    rows, grams = [], []

    def take(parts: list[str], owners: list[int]) -> None:
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        if len(points) < GRAM:
            return
        sizes = np.array([len(p) for p in parts])
        row = np.repeat(np.arange(len(parts)), sizes)
        at = np.flatnonzero(row[:-2] == row[2:])
        codes = _codes(points)[at]
        if wanted is not None:
            some, codes = wanted.places(codes)
            at = at[some]
        row = np.array(owners)[row[at]]
        order = np.lexsort((codes, row))
        row, codes = row[order], codes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
        rows.append(row[new])
        grams.append(codes[new])

    parts, owners, held, split = [], [], 0, False
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - GRAM + 1, 0), _WINDOW):
            split |= start > 0
            part = text[start:start + _WINDOW + GRAM - 1]
            if held + len(part) > _WINDOW and parts:
                take(parts, owners)
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(i)
            held += len(part)
    if parts:
        take(parts, owners)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, gram = np.concatenate(rows), np.concatenate(grams)
    if split:
        both = np.unique(np.stack([row, gram]), axis=1)
        row, gram = both[0], both[1]
    return row, gram


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size numbers) for each pair."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Asked:
    """The queries of one group, ready to be matched with slices of entries."""

    def __init__(self, words: pa.ListArray):
        n = len(words)
        sizes = words.value_lengths().to_numpy()
        coded = words.flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        owner = np.repeat(np.arange(n), sizes)
        pair, self.times = np.unique(owner * len(self.words) + coded.indices.to_numpy(), return_counts=True)
        self.query, self.word = pair // len(self.words), pair % len(self.words)
        self.first = np.searchsorted(self.query, np.arange(n + 1))
        self.needed = np.maximum(-(-sizes // 2), 1)
        self.spare = sizes - self.needed
        of_word, codes = grams_of(self.words)
        unique, self.gram = np.unique(codes, return_inverse=True)
        self.wanted = Wanted(unique)
        self.first_gram = np.searchsorted(of_word, np.arange(len(self.words)))

    def matches(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, query, keywords found) of each match."""
        row, gram = grams_of(texts, self.wanted)
        order = np.argsort(gram, kind="stable")
        row, gram = row[order], gram[order]
        starts = np.searchsorted(gram, np.arange(len(self.wanted.codes) + 1))
        listed = np.diff(starts)
        least = np.minimum.reduceat(listed[self.gram] << 32 | self.gram, self.first_gram)
        rare, at_most = least & 0xFFFFFFFF, least >> 32
        # The rarest keywords of each query, until more than it can spare are among them.
        order = np.lexsort((at_most[self.word], self.query))
        before = np.cumsum(self.times[order]) - self.times[order]
        start = before[self.first[:-1].clip(max=max(len(before) - 1, 0))]
        looked_up = np.zeros(len(order), bool)
        looked_up[order] = before - start[self.query[order]] <= self.spare[self.query[order]]
        holders: dict[int, np.ndarray] = {}
        sizes = np.zeros(len(self.words), np.int64)
        for w in np.unique(self.word[looked_up & (at_most[self.word] > 0)]).tolist():
            word, some = self.words[w], row[starts[rare[w]]:starts[rare[w] + 1]]
            if len(word) > GRAM:
                some = some[[word in texts[r] for r in some.tolist()]]
            if len(some):
                holders[w], sizes[w] = some, len(some)
        if not holders:
            return
        flat = np.concatenate(list(holders.values()))
        begin = np.zeros(len(self.words), np.int64)
        begin[list(holders)] = np.cumsum(sizes[list(holders)]) - sizes[list(holders)]
        pairs = np.flatnonzero(looked_up & (sizes[self.word] > 0))
        cost = np.cumsum(sizes[self.word[pairs]])
        low = 0
        while low < len(pairs):
            # Whole queries, of about so many pairs.
            high = int(np.searchsorted(cost, (cost[low - 1] if low else 0) + _PAIRS, "right"))
            high = max(high, low + 1)
            high = int(np.searchsorted(self.query[pairs], self.query[pairs[high - 1]], "right"))
            yield from self._counted(pairs[low:high], looked_up, flat, begin, sizes, rare, row, starts, texts)
            low = high

    def _counted(self, pairs, looked_up, flat, begin, sizes, rare, row, starts, texts):
        """Matches among the texts that hold a looked-up keyword of these pairs' queries."""
        n = len(texts)
        size = sizes[self.word[pairs]]
        code = np.repeat(self.query[pairs], size) * n + flat[_expanded(begin[self.word[pairs]], size)]
        both, inverse = np.unique(code, return_inverse=True)
        hits = np.bincount(inverse, np.repeat(self.times[pairs], size), len(both)).astype(np.int64)
        # What the keywords that were not looked up can add at most.
        others = np.bincount(self.query[~looked_up], self.times[~looked_up], len(self.needed)).astype(np.int64)
        open_ones = hits + others[both // n] >= self.needed[both // n]
        both, hits = both[open_ones], hits[open_ones]
        step = max(1, _PAIRS // max(int(np.diff(self.first).max(initial=1)), 1))
        for low in range(0, len(both), step):
            query, text, found = both[low:low + step] // n, both[low:low + step] % n, hits[low:low + step]
            each = np.diff(self.first)[query]
            pair = _expanded(self.first[query], each)
            owner = np.repeat(np.arange(len(query)), each)
            rest = ~looked_up[pair]
            pair, owner = pair[rest], owner[rest]
            # Words whose rarest trigram the text lacks are out; the others are looked for, once per word and text.
            asked, which = np.unique(self.word[pair] * n + text[owner], return_inverse=True)
            held = np.array([self._listed(row, starts, int(rare[a // n]), int(a % n)) and self.words[a // n] in texts[a % n] for a in asked.tolist()], bool)
            if len(held):
                found = found + np.bincount(owner, self.times[pair] * held[which], len(query)).astype(np.int64)
            enough = found >= self.needed[query]
            yield text[enough], query[enough], found[enough]

    @staticmethod
    def _listed(row: np.ndarray, starts: np.ndarray, gram: int, text: int) -> bool:
        low, high = starts[gram], starts[gram + 1]
        at = low + np.searchsorted(row[low:high], text)
        return bool(at < high and row[at] == text)


def _text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of bounded rows and text."""
    sizes = pc.utf8_length(batch.column("hay")).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(ends):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _SLICE_POINTS, "right"))
        high = min(max(high, low + 1), low + _SLICE_ROWS)
        yield batch.slice(low, high - low)
        low = high


def _asked_by_group(shipped: pa.Table) -> dict[tuple[str, str], pa.Table]:
    keys = list(zip(*(shipped.column(k).to_pylist() for k in _ON)))
    groups: dict[tuple[str, str], list[int]] = {}
    for i, key in enumerate(keys):
        groups.setdefault(key, []).append(i)
    return {key: shipped.take(pa.array(at)) for key, at in groups.items()}


def _tag_allows(entry_tags: list, text: np.ndarray, wanted: list, query: np.ndarray) -> np.ndarray:
    """Which (text, query) pairs the query's tag lets through; none, or an empty one, lets all through."""
    return np.array([not wanted[q] or wanted[q] in (entry_tags[t] or ()) for t, q in zip(text.tolist(), query.tolist())], bool)


_FOUND = f"{_GROUP_DDL}, query_id bigint, id bigint, score int, lim int"


def matched_in_scan(searched: DataFrame, asking: DataFrame) -> DataFrame:
    """Matches of a batch of queries that fits on every executor: role, category, query_id, id, score, lim.

    ``searched``: role, category, id, tags, hay; ``asking``: role, category, query_id, words (at least one each), tag, lim.
    """
    schema = pa.schema([("role", pa.string()), ("category", pa.string()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int32()), ("lim", pa.int32())])
    shipped = searched.sparkSession.sparkContext.broadcast(asking.select(*_ON, "query_id", "words", "tag", "lim").toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _asked_by_group(shipped.value)
        asked: dict[tuple[str, str], Asked] = {}
        for batch in (s for b in batches for s in _text_slices(b)):
            keys = np.array([f"{a}\0{b}" for a, b in zip(*(batch.column(k).to_pylist() for k in _ON))], object)
            for key in dict.fromkeys(keys.tolist()):
                group = tuple(key.split("\0"))
                if group not in tables:
                    continue
                table = tables[group]
                if group not in asked:
                    asked[group] = Asked(table.column("words").combine_chunks())
                rows = batch.take(pa.array(np.flatnonzero(keys == key)))
                texts = [t or "" for t in rows.column("hay").to_pylist()]
                tags, wanted = rows.column("tags").to_pylist(), table.column("tag").to_pylist()
                for text, query, hits in asked[group].matches(texts):
                    if any(wanted):
                        allowed = _tag_allows(tags, text, wanted, query)
                        text, query, hits = text[allowed], query[allowed], hits[allowed]
                    if len(text):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([group[0]] * len(text)), pa.array([group[1]] * len(text)), table.column("query_id").take(pa.array(query)).combine_chunks(),
                            rows.column("id").take(pa.array(text)), pa.array(hits, pa.int32()), table.column("lim").take(pa.array(query)).combine_chunks()], schema=schema)

    return spread_small(searched).mapInArrow(scan, _FOUND)


# Posting lists -------------------------------------------------------------------------------------


def _listing(codes: pa.Array | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if codes is None else Wanted(codes.to_numpy())
        for batch in (s for b in batches for s in _text_slices(b)):
            row, gram = grams_of([t or "" for t in batch.column("hay").to_pylist()], wanted)
            if wanted is not None:
                gram = wanted.codes[gram]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in (*_ON, "id", "_b")], pa.array(gram)], names=[*_ON, "id", "_b", "gram"])

    return run


def postings(searched: DataFrame, wanted: DataFrame | None = None, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Posting lists role, category, gram, _b, ids of entries (role, category, id, hay), one per block of a group's entries.

    ``wanted`` (gram): only these, if they are few enough to ship.
    """
    listed = None
    if wanted is not None:
        found = wanted.select("gram").distinct().limit(MAX_SHIPPED_GRAMS + 1).toArrow().column("gram").combine_chunks()
        listed = found.take(pc.sort_indices(found)) if len(found) <= MAX_SHIPPED_GRAMS else None
    plan = plan_blocks([searched], GROUP_KEYS, block_rows)
    rows = with_block_counts(searched.select(*_ON, "id", "hay"), plan).withColumn("_b", block_of("id", F.col("_nb0"))).drop("_nb0")
    pairs = spread_small(rows).mapInArrow(_listing(listed), f"{_GROUP_DDL}, id bigint, _b int, gram bigint")
    return pairs.groupBy(*_ON, "gram", "_b").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, gram = grams_of(batch.column("word").to_pylist())
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in (*_ON, "word")], pa.array(gram)], names=[*_ON, "word", "gram"])


def word_grams(words: DataFrame) -> DataFrame:
    """role, category, word, gram of the distinct words (role, category, word)."""
    return words.select(*_ON, "word").distinct().mapInArrow(_word_grams, f"{_GROUP_DDL}, word string, gram bigint")


def candidates(asking: DataFrame, lists: DataFrame, grams: DataFrame) -> DataFrame:
    """(role, category, query_id, id): entries under the rarest trigram of a keyword that the query cannot spare.

    ``asking``: role, category, query_id, words; ``lists``: postings; ``grams``: ``word_grams`` of the words.
    """
    pairs = asking.select(*_ON, "query_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    pairs = pairs.groupBy(*_ON, "query_id", "word", "n").agg(F.count(F.lit(1)).alias("times"))
    frequency = lists.groupBy(*_ON, "gram").agg(F.sum(F.size("ids")).alias("df"))
    rated = grams.join(frequency, [*_ON, "gram"], "left").select(*_ON, "word", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram").alias("r"))
    rare = rated.groupBy(*_ON, "word").agg(F.min("r").alias("r"))
    before = Window.partitionBy(*_ON, "query_id").orderBy("r.df", "word").rowsBetween(Window.unboundedPreceding, -1)
    spare = F.col("n") - F.greatest(F.ceil(F.col("n") / 2), F.lit(1))
    looked_up = pairs.join(rare, [*_ON, "word"]).withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0)))
    looked_up = looked_up.where((F.col("before") <= spare) & (F.col("r.df") > 0)).select(*_ON, "query_id", F.col("r.gram").alias("gram")).distinct()
    return looked_up.join(lists, [*_ON, "gram"]).select(*_ON, "query_id", F.explode("ids").alias("id")).distinct()


def _verified(searched: DataFrame, asking: DataFrame, pairs: DataFrame) -> DataFrame:
    e, q = searched.select(*_ON, "id", "tags", "hay"), asking.select(*_ON, "query_id", "words", "tag", "lim")
    rows = pairs.join(q, [*_ON, "query_id"]).join(e, [*_ON, "id"])
    no_tag = F.coalesce("tag", F.lit("")).eqNullSafe("")
    match: Column = X.keyword_match(F.col("words"), F.col("hay")) & (no_tag | F.coalesce(F.array_contains("tags", F.col("tag")), F.lit(False)))
    return rows.where(match).select(*_ON, "query_id", "id", X.keyword_hits(F.col("words"), F.col("hay")).alias("score"), "lim")


def matched_by_postings(searched: DataFrame, asking: DataFrame, *, block_rows: int = BLOCK_ROWS, lists: DataFrame | None = None) -> DataFrame:
    """As ``matched_in_scan`` for queries of any number. ``lists``: posting lists at hand for all of ``searched``."""
    grams = materialize(word_grams(asking.select(*_ON, F.explode("words").alias("word"))), "word-grams")
    if lists is None:
        lists = materialize(postings(searched, grams, block_rows=block_rows), "postings")
    return _verified(searched, asking, candidates(asking, lists, grams))


def rows_under_rare_grams(lists: DataFrame, words: Sequence[str], spare: int) -> DataFrame:
    """(role, category, id) of listed entries that may hold more of ``words`` (repeats counted) than all but ``spare``.

    Only the lists of these words' trigrams are read, and of those only the rare ones are unfolded.
    """
    distinct = list(dict.fromkeys(words))
    of_word, codes = grams_of(distinct)
    mine = lists.where(F.col("gram").isin([int(c) for c in np.unique(codes)]))
    # One number per trigram of the query.
    listed = {r["gram"]: r["n"] for r in mine.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}
    rarest = {w: min((listed.get(int(c), 0), int(c)) for c in codes[of_word == i]) for i, w in enumerate(distinct)}
    asked, passed = [], 0
    for w in sorted(distinct, key=lambda w: (rarest[w], w)):
        if passed <= spare and rarest[w][0]:
            asked.append(rarest[w][1])
        passed += words.count(w)
    return mine.where(F.col("gram").isin(asked)).select(*_ON, F.explode("ids").alias("id")).distinct()
