"""Jaccard self-join of word n-gram sets by token-combination prefixes.

Tokens are hashed n-grams, ordered by hash. If two sets of sizes up to n have Jaccard similarity t,
their first n - ceil(t * n) + k tokens share k of them at least. So:

1. *Filter.* A set less than a share t of whose tokens is in any other set has no partner; most sets
   end here. In the order "tokens of one set only come first" such a set's prefix would hold nothing
   else. To tell, each slice of documents sends its tokens, cut to 40 bits or more, as packed
   ascending lists, one per bucket of hashes; a bucket answers with counts per document. Tokens that
   agree in those bits only keep a set longer, nothing else.
2. *Classes.* Tokens in few sets are rare and index their set singly. Frequent tokens are dealt by
   hash into g classes, and what is indexed is each pair of frequent tokens of one class. With
   k = 1 + 2g, a similar pair shares more than g index keys, by the pigeonhole principle: all its rare
   tokens, and of the others of each class all but one. g grows with the set (about n / 12), so that a set of n frequent tokens
   gives about n / 2 combinations, not n * n. Sets near a change of g are indexed under both.
3. *Verify.* Equal sets are one node. Nodes that share many keys come into one block of bounded size
   (small families share blocks, large ones have several), each with its keys and its set. A task
   compares, on whole sets, what shares a key and is not connected yet, and gives only the links that
   connect. A family in several blocks that is not connected by then goes on block by block: its first block
   meets its others, then the others meet each other, whole blocks in one task, so that the keys that all of it shares
   make no rows. What is left lies between families: keys of one family or one component are closed, a node goes on only if
   enough of its keys are open, and the blocks that share enough of these are compared, a key's first block before the others.
   Keys with the same blocks are counted together. No pair of nodes is ever a row, but for the links.

Every decision is exact on 52-bit token hashes. The answer is the components, so links inside one
component beyond those that connect it are not listed.

Defined results: null, empty and wordless texts have an empty set and link with nothing; fewer
words than n make one token; rows of equal text link; rows without doc_id count as the largest id,
and a component of such rows alone has no id; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .scratch import NO_ID, keyed, settled, with_keys

WORDS, PERCENT = 5, 75
# A token in at least this many sets is frequent.
FREQUENT = 64
# Nodes compared in one task at a time.
BLOCK_NODES = 256


def token_sets(piece: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit token hashes of all rows, ascending within each row, and each row's first place."""
    raw, offsets = K.utf8(piece.column("text"))
    raw = K.lowered(raw)
    starts, ends, rows = K.word_places(raw, offsets)
    words = K.stretch_hashes(raw, starts, ends)
    sizes = np.diff(rows)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    a = np.concatenate([K.windows_in_rows(rows, n), rows[short]])
    b = np.concatenate([a[:len(a) - len(short)] + n, rows[short + 1]])
    row = np.searchsorted(rows, a, "right") - 1
    tagged = K.Rolling(words, K.WORD_BASE).of(a, b) >> np.uint64(12) | row.astype(np.uint64) << np.uint64(52)
    tagged = np.unique(tagged)
    firsts = np.searchsorted(tagged >> np.uint64(52), np.arange(len(piece) + 1))
    return (tagged & np.uint64((1 << 52) - 1)).view(np.int64), firsts


_SURVEY = "portion long, at int, bucket int, id long, key long, node long, n long, tokens binary, places binary"
_SURVEY_ARROW = pa.schema([("portion", pa.int64()), ("at", pa.int32()), ("bucket", pa.int32()), ("id", pa.int64()), ("key", pa.int64()),
                           ("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("places", pa.binary())])


def _row_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.append(np.uint64(0), np.cumsum(values))
    return sums[firsts[1:]] - sums[firsts[:-1]]


def _listed(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(values[K.ranges(starts, sizes)]))


def _planes(values: np.ndarray) -> bytes:
    """The values' lowest bytes, then their second bytes, ...: what is small or sorted then compresses."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _surveyed(n: int, bits: int):
    """One row per document (its node: a hash of the set, a second hash, the size), and one row per slice of documents and
    bucket of tokens: the 32 bits after the bucket's, ascending as differences, and the document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in K.slices(b, "text")):
            tokens, firsts = token_sets(piece, n)
            sizes = np.diff(firsts)
            node = K.mixed(_row_sums(K.mixed(tokens.view(np.uint64), 1), firsts), 3)
            portion = uuid.uuid4().int & (1 << 63) - 1
            yield pa.record_batch({
                "portion": np.full(len(piece), portion), "at": np.arange(len(piece), dtype=np.int32), "bucket": np.full(len(piece), -1, np.int32),
                "id": piece.column("id"), "key": piece.column("key"), "node": K.signed(node), "n": sizes.astype(np.int64),
                "tokens": pa.nulls(len(piece), pa.binary()), "places": pa.nulls(len(piece), pa.binary()),
            }, schema=_SURVEY_ARROW)
            cut = (tokens >> (52 - bits - 32)).astype(np.uint64)
            order = np.argsort(cut, kind="stable")
            cut, places = cut[order], np.repeat(np.arange(len(piece), dtype=np.uint16), sizes)[order]
            bounds = np.searchsorted(cut >> np.uint64(32), np.arange((1 << bits) + 1))
            low = (cut & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            full = np.flatnonzero(np.diff(bounds))
            stretches = [slice(bounds[i], bounds[i + 1]) for i in full]
            nothing = pa.nulls(len(full), pa.int64())
            yield pa.record_batch({
                "portion": np.full(len(full), portion), "at": np.full(len(full), len(piece), np.int32), "bucket": full.astype(np.int32),
                "id": nothing, "key": nothing, "node": nothing, "n": nothing,
                "tokens": pa.array([_planes(np.diff(low[x], prepend=np.uint32(0))) for x in stretches], pa.binary()),
                "places": pa.array([_planes(places[x]) for x in stretches], pa.binary()),
            }, schema=_SURVEY_ARROW)

    return run


def _shared_counts(group: pa.Table) -> pa.Table:
    """Of one bucket: how many tokens of each document some other document has, too. Only documents that have such tokens are named."""
    portions, sizes = group.column("portion").to_numpy(), group.column("at").to_numpy()
    tokens = [np.cumsum(_from_planes(x.as_py(), np.uint32), dtype=np.uint32) for x in group.column("tokens")]
    starts = np.append(0, np.cumsum(sizes.astype(np.int64)))
    rows = np.concatenate([_from_planes(x.as_py(), np.uint16) + s for x, s in zip(group.column("places"), starts)])
    tokens = np.concatenate(tokens)
    order = np.argsort(tokens)
    tokens = tokens[order]
    same = tokens[1:] == tokens[:-1]
    again = np.append(False, same) | np.append(same, False)
    rows, counts = np.unique(rows[order[again]], return_counts=True)
    bounds = np.searchsorted(rows, starts)
    some = np.flatnonzero(np.diff(bounds))
    stretches = [slice(bounds[i], bounds[i + 1]) for i in some]
    return pa.table({
        "portion": portions[some], "at": sizes[some],
        "places": pa.array([_planes((rows[x] - starts[i]).astype(np.uint16)) for i, x in zip(some, stretches)], pa.binary()),
        "counts": pa.array([_planes(counts[x].astype(np.uint32)) for x in stretches], pa.binary()),
    })


def _total_counts(group: pa.Table) -> pa.Table:
    total = np.zeros(group.column("at")[0].as_py(), np.int64)
    for places, counts in zip(group.column("places"), group.column("counts")):
        total[_from_planes(places.as_py(), np.uint16)] += _from_planes(counts.as_py(), np.uint32)
    return pa.table({"portion": np.full(len(total), group.column("portion")[0].as_py()), "at": np.arange(len(total), dtype=np.int32), "shared": total})


def _whole_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in K.slices(b, "text")):
            tokens, firsts = token_sets(piece, n)
            sizes = np.diff(firsts)
            yield pa.record_batch({"node": piece.column("node"), "n": sizes.astype(np.int64), "tokens": _listed(tokens, firsts[:-1], sizes)})

    return run


class _Joined:
    """Which of some nodes are known to be connected."""

    def __init__(self, labels: np.ndarray):
        _, self._up = np.unique(labels, return_inverse=True)
        self._up = self._up.tolist()
        self._own = list(range(max(self._up, default=-1) + 1))
        self._of = self._up

    def root(self, i: int) -> int:
        at = self._of[i]
        while self._own[at] != at:
            self._own[at] = self._own[self._own[at]]
            at = self._own[at]
        return at

    def join(self, i: int, j: int) -> None:
        self._own[self.root(i)] = self.root(j)


def _block_links(percent: int):
    """Of one or two blocks of nodes (rows: node, label, side, keys, tokens): links that connect what is not connected yet,
    between nodes that share a key; of two blocks, only links across."""

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        node, joined = group.column("node").to_numpy(), _Joined(group.column("label").to_numpy())
        lists = group.column("keys").combine_chunks()
        owner = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy())
        keys = lists.flatten().to_numpy()
        order = np.lexsort((keys, keys & 31))
        owner, keys = owner[order], keys[order]
        levels = keys & 31
        bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        meet, counts, level = np.zeros((len(node), len(node)), bool), np.zeros((len(node), len(node)), np.int32), -1
        for low, high in zip(bounds.tolist(), [*bounds[1:].tolist(), len(keys)]):
            if int(levels[low]) != level:
                meet |= counts >= 1 + (1 << max(level, 0))
                counts[:], level = 0, int(levels[low])
            if high - low > 1:
                some = owner[low:high]
                counts[some[:, None], some[None, :]] += 1
        meet |= counts >= 1 + (1 << max(level, 0))
        if side.any():
            meet &= side[:, None] != side[None, :]
        tokens = group.column("tokens").combine_chunks()
        sizes = tokens.value_lengths().to_numpy()
        meet &= np.minimum(sizes[:, None], sizes[None, :]) * 100 >= percent * np.maximum(sizes[:, None], sizes[None, :])
        ends = np.cumsum(sizes)
        flat = tokens.flatten().to_numpy()
        u, v = [], []
        for i in range(len(node)):
            mine = flat[ends[i] - sizes[i]:ends[i]]
            for j in np.flatnonzero(meet[i, i + 1:]) + i + 1:
                if joined.root(i) == joined.root(j):
                    continue
                theirs = flat[ends[j] - sizes[j]:ends[j]]
                short, long = (mine, theirs) if len(mine) < len(theirs) else (theirs, mine)
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                both = int((long[at] == short).sum())
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    joined.join(i, j)
                    u.append(node[i])
                    v.append(node[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _classes(n: Column) -> Column:
    """Number of classes of a set of n tokens: a power of two, n / 16 < g <= n / 8, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(8)) / 8.0))))).cast("long")


def _index(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(k, node): index keys of each node; a key's lowest five bits are log2 g."""
    key = lambda *columns: F.xxhash64(*columns).bitwiseAND(F.lit(~31)).bitwiseOR(F.log2(F.col("g").cast("double")).cast("long"))
    least = F.floor(F.col("n") * percent / 100.0).cast("long")
    g = F.array_distinct(F.array(_classes(F.col("n")), _classes(least)))
    size = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 + 2 * F.col("g"))
    entries = sets.select("node", "n", "tokens", F.explode(g).alias("g")).select(
        "node", "n", "g", F.explode(F.slice("tokens", 1, size.cast("int"))).alias("token"))
    sizes = settled(entries.groupBy("g", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "op4-df")
    entries = settled(entries.join(sizes, ["g", "token"]), "op4-entries")
    rare = entries.where(F.col("df") < frequent).select(key("g", "token").alias("k"), "node")
    common = entries.where(F.col("df") >= frequent).groupBy("node", "n", "g", F.pmod("token", F.col("g")).alias("class")).agg(
        F.array_sort(F.collect_list("token")).alias("ts")).where("size(ts) > 1")
    first = common.select("*", F.posexplode("ts").alias("i", "one"))
    pairs = first.select("node", "n", "g", "one", F.explode(F.expr("slice(ts, i + 2, size(ts))")).alias("two"))
    return settled(rare.unionByName(pairs.select(key("g", "one", "two").alias("k"), "node")), "op4-index", entries)


def _blocks(index: DataFrame, block_nodes: int) -> DataFrame:
    """(node, family, block): nodes that share many keys are a family and come together, at most about ``block_nodes`` in a block."""
    hubs = settled(index.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("k", "hub"), "op4-hubs")
    met = index.join(hubs, "k").where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("best"))
    families = components(best.select(F.col("node").alias("u"), F.col("best.hub").alias("v")), "op4-families")
    families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    sizes = settled(families.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "op4-sizes")
    shelves = F.lit(max(1, -(-families.count() // block_nodes)))
    large = F.col("size") * 4 >= block_nodes
    parts = F.ceil(F.col("size") / block_nodes)
    block = F.when(large, F.xxhash64("root", F.pmod(F.xxhash64("node"), parts))).otherwise(F.pmod(F.xxhash64("root"), shelves))
    own = families.join(sizes, "root").select("node", F.col("root").alias("family"), block.alias("block"), F.lit(False).alias("guest"))
    # The head of a family in several blocks is a guest in each: what is close to it is connected at once.
    several = sizes.where(large & (parts > 1)).select("root", F.explode(F.sequence(F.lit(0), parts.cast("long") - 1)).alias("part"))
    guests = several.select(F.col("root").alias("node"), F.col("root").alias("family"), F.xxhash64("root", "part").alias("block"))
    guests = guests.join(own.where("block is not null").select("node", F.col("block").alias("home")), "node").where("block != home")
    return settled(own.unionByName(guests.select("node", "family", "block", F.lit(True).alias("guest"))), "op4-blocks", hubs, sizes)


def _linked(sets: DataFrame, percent: int, frequent: int, block_nodes: int) -> DataFrame:
    """(node, root) of the components of similar sets."""
    index = _index(sets, percent, frequent)
    blocks = _blocks(index, block_nodes)
    schema = "u long, v long"
    # Inside the blocks first. Nodes arrive once each, with their keys and their set.
    keys = index.join(blocks, "node").groupBy("block", "node", "guest").agg(F.collect_set("k").alias("keys"))
    members = settled(keys.join(sets.select("node", "tokens"), "node"), "op4-members")
    rows = members.select("block", "node", F.col("node").alias("label"), F.lit(0).alias("side"), "keys", "tokens")
    links = settled(rows.groupBy("block").applyInArrow(_block_links(percent), schema), "op4-links")
    roots = components(links, "op4-components")
    home = blocks.where("not guest").select("node", "family", "block")

    def labelled() -> DataFrame:
        """(node, family, block, label): where each node is at home, and what it is connected with by now."""
        return settled(home.join(roots, "node", "left").select("node", "family", "block", F.coalesce("root", "node").alias("label")), "op4-labels")

    def across(pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The components, with the links between ``pairs`` of blocks of ``held`` (block, node, label, keys, tokens)."""
        asked = pairs.select(F.col("block1").alias("block")).unionByName(pairs.select(F.col("block2").alias("block"))).distinct()
        held = settled(held.join(asked, "block", "left_semi").select("block", "node", "label", "keys", "tokens"), "op4-held")
        sides = [
            pairs.withColumn("block", F.col(f"block{i + 1}")).join(held, "block").select("block1", "block2", "node", "label", F.lit(i).alias("side"), "keys", "tokens")
            for i in (0, 1)
        ]
        found = settled(sides[0].unionByName(sides[1]).groupBy("block1", "block2").applyInArrow(_block_links(percent), schema), "op4-across", held)
        if found.isEmpty():
            return roots
        return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found), "op4-components")

    # Then between the blocks of a family that is not connected yet: its first block with the others, which connects most, then the others.
    for pairs_of in (_first_parts, _other_parts):
        labels = labelled()
        pairs = settled(pairs_of(labels), "op4-parts")
        if not pairs.isEmpty():
            roots = across(pairs, members.where("not guest").select("block", "node", "keys", "tokens").join(labels.select("node", "label"), "node"))
    # Then between families: first each key's blocks with the first of them, then all that this leaves open.
    rows = opened = _between_families(index, labelled())
    for pairs_of in (_first_pairs, _all_pairs) if not opened.isEmpty() else ():
        # Blocks meet here, not nodes: a key has one row per block, with its family if it is one.
        places = rows.groupBy("k", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("family").alias("f"), F.max("family").alias("l"))
        places = settled(places.select("k", "block", "low", "high", F.when(F.col("f") == F.col("l"), F.col("f")).alias("family")), "op4-places")
        spread = places.groupBy("k").agg(F.min("low").alias("a"), F.max("high").alias("z"), F.min("block").alias("b"), F.max("block").alias("y"))
        places = settled(places.join(spread.where("a < z and b < y").select("k"), "k"), "op4-open", places)
        # A similar pair shares more than g keys, so its blocks do.
        pairs = pairs_of(places).where(F.col("n") > F.pow(F.lit(2), F.col("level"))).select("block1", "block2").distinct()
        pairs = settled(pairs, "op4-block-pairs", places)
        if not pairs.isEmpty():
            held = rows.groupBy("block", "node", "label").agg(F.collect_set("k").alias("keys"))
            roots = across(pairs, held.join(sets.select("node", "tokens"), "node"))
            rows = opened.drop("label").join(labelled().select("node", "label"), "node")
    return roots


def _parts(labels: DataFrame) -> DataFrame:
    """(family, block, low, high, head): the blocks of families that have several and are not connected; head: the first of them."""
    parts = labels.groupBy("family", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    several = parts.groupBy("family").agg(F.min("block").alias("head"), F.max("block").alias("last"), F.min("low").alias("a"), F.max("high").alias("z"))
    return parts.join(several.where("head < last and a < z").select("family", "head"), "family")


def _first_parts(labels: DataFrame) -> DataFrame:
    """(block1, block2): each family's first block with its others."""
    return _pairs_of_parts(_parts(labels)).where("block1 = head")


def _other_parts(labels: DataFrame) -> DataFrame:
    """(block1, block2): the other blocks of each family."""
    return _pairs_of_parts(_parts(labels)).where("block1 != head")


def _pairs_of_parts(parts: DataFrame) -> DataFrame:
    one, two = (parts.select("family", *more, *[F.col(c).alias(f"{c}{i}") for c in ("block", "low", "high")]) for i, more in ((1, ("head",)), (2, ())))
    # Two blocks of one component have nothing left to connect.
    return one.join(two, "family").where("block1 < block2 and (low1 < high2 or low2 < high1)").select("head", "block1", "block2")


def _between_families(index: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, node, family, block, label): the keys that a node shares with what is neither of its family nor connected, if these are enough.

    A pair still to be found shares more than g keys, and every one of them is in two families and two components.
    """
    rows = index.join(labels, "node")
    spread = rows.groupBy("k").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.min("family").alias("f"), F.max("family").alias("l"))
    rows = settled(rows.join(spread.where("a < z and f < l").select("k"), "k", "left_semi"), "op4-shared", index)
    enough = rows.groupBy("node", _level()).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.pow(F.lit(2), F.col("level")))
    return settled(rows.select("*", _level()).join(enough.select("node", "level"), ["node", "level"]).drop("level"), "op4-between", rows)


def _level() -> Column:
    return F.col("k").bitwiseAND(F.lit(31)).alias("level")


def _first_pairs(places: DataFrame) -> DataFrame:
    """(block1, block2, level, n): each key's first block with its others, and the keys that they share."""
    heads = places.groupBy("k").agg(F.min(F.struct("block", "low", "high", "family")).alias("head")).select(
        "k", F.col("head.block").alias("block1"), F.col("head.low").alias("low1"), F.col("head.high").alias("high1"), F.col("head.family").alias("family1"))
    others = places.select("k", F.col("block").alias("block2"), "low", "high", "family").join(heads, "k")
    return others.where("block1 < block2 and (low1 < high or low < high1) and (family1 = family) is not true").groupBy("block1", "block2", _level()).agg(F.count(F.lit(1)).alias("n"))


def _all_pairs(places: DataFrame) -> DataFrame:
    """(block1, block2, level, n) of blocks that share keys, unless both hold one family or nothing but the key's most common component.

    Keys of the same blocks, which the members of a family share by the thousand, count as one with their number as its weight.
    """
    common = places.groupBy("k", "low").agg(F.count(F.lit(1)).alias("c")).groupBy("k").agg(F.max(F.struct("c", "low")).alias("m")).select("k", F.col("m.low").alias("m"))
    marked = settled(places.join(common, "k").select("k", "block", "family", ((F.col("low") == F.col("high")) & (F.col("low") == F.col("m"))).alias("done")), "op4-marked")
    seeds = [F.bit_xor(F.xxhash64("block", "done", "family", F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]
    alike = marked.groupBy("k", _level()).agg(F.count(F.lit(1)).alias("blocks"), *seeds)
    kinds = settled(alike.groupBy("level", "blocks", "s1", "s2").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("keys")).select("k", "level", "keys"), "op4-kinds")
    one, two = (marked.select("k", *[F.col(c).alias(f"{c}{i}") for c in ("block", "done", "family")]).join(kinds.select("k", *more), "k") for i, more in ((1, ("level", "keys")), (2, ())))
    return one.join(two, "k").where("block1 < block2 and not (done1 and done2) and (family1 = family2) is not true").groupBy("block1", "block2", "level").agg(F.sum("keys").alias("n"))


def _bucket_bits(docs: DataFrame) -> int:
    """Buckets of some two million tokens, by the size of the files: a plan's estimate, no run."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(20, max(5, (size // 4 // 2_000_000).bit_length()))


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Per row: doc_id, key (of the row), n_shingles, component_id (smallest doc_id of its component), is_first (the row has it)."""
    if not 50 < percent <= 100:
        raise ValueError("percent lies over 50, up to 100")
    rows = keyed(docs)
    survey = settled(rows.mapInArrow(_surveyed(words, _bucket_bits(docs)), _SURVEY), "op4-survey")
    buckets = survey.where("bucket >= 0").select("portion", "at", "bucket", "tokens", "places")
    counts = buckets.groupBy("bucket").applyInArrow(_shared_counts, "portion long, at int, places binary, counts binary")
    counts = counts.groupBy("portion").applyInArrow(_total_counts, "portion long, at int, shared long")
    described = survey.where("bucket < 0").select("portion", "at", "id", "key", "node", "n").join(counts, ["portion", "at"], "left")
    described = settled(described.drop("portion", "at"), "op4-described", survey)
    hopeful = described.where((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent))
    chosen = hopeful.groupBy("node").agg(F.min("key").alias("key"))
    sets = rows.select("key", "text").join(chosen, "key").mapInArrow(_whole_sets(words), "node long, n long, tokens array<long>")
    sets = settled(sets.dropDuplicates(["node"]), "op4-sets")
    roots = _linked(sets, percent, frequent, block_nodes)
    placed = described.select("id", "key", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    named = settled(named.select("root", F.col("first.id").alias("least"), F.col("first.key").alias("least_key")), "op4-named")
    alone = F.col("n") == 0
    out = placed.join(named, "root").withColumn("least", F.when(alone, F.col("id")).otherwise(F.col("least")))
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "key", F.col("n").alias("n_shingles"),
                      F.nullif("least", F.lit(NO_ID)).alias("component_id"), (alone | (F.col("key") == F.col("least_key"))).alias("is_first"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of ``docs``, the one of smallest doc_id, with all its columns. Rows without words all stay."""
    kept = with_keys(docs, ngram_components(docs, **options).where("is_first"), "left_semi")
    return kept.dropDuplicates([next(c for c in kept.columns if c not in docs.columns)]).select(*docs.columns)
