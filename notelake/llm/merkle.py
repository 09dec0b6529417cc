"""Merkle manifest of a table, its trees stored in van Emde Boas layout.

Rows are leaves, in doc_id order per source; every three consecutive nodes have their hash as parent, up to one
subroot per source; the subroots, in source order, have a tree of their own. A tree is cut into aligned blocks of
``BLOCK_LEVELS`` levels (up to 3**BLOCK_LEVELS entries). A block is one row of the manifest, its digests one binary
in van Emde Boas order: a tree of h levels is the one of its upper half, then the trees below it, left to right, each
stored the same way. The place of (depth, number) follows by arithmetic alone; construction and the
look-up of siblings use it. The roots of a tier's blocks are the entries of the next tier's, until a
source has one block. Tiers number the logarithm of the rows to the base of a block's size.

No source, however large, meets in one task: leaves get their places from a range partitioning and prefix
sums over partitions, and a task holds one block. The driver sees one number per tier. Paths go down
again block by block, so each leaf meets its siblings in its own block and one string for all above it.

Defined results: null values are hashed as ``-``, empty texts as ``0:``; null sources come first, as one source;
rows without doc_id come after the others of their source, and are not tampered with; rows of equal doc_id are
ordered by their leaf; equal rows are leaves of their own; columns besides the five are ignored; an empty
table has no rows, no blocks and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import free_name, settled

FAN = 3
BLOCK_LEVELS = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = "tree string, block long, size long, tiers_done boolean, nodes binary, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Layout ------------------------------------------------------------------------------------------


def tree_size(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(depth: int, number: np.ndarray, levels: int) -> np.ndarray:
    """Place of the ``number``-th nodes at ``depth`` (root: 0) of a tree of ``levels`` levels."""
    place = np.zeros_like(number)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        # Below the cut: pass the upper tree and the lower trees to the left.
        depth, levels = depth - upper, levels - upper
        below = FAN**depth
        place = place + tree_size(upper) + number // below * tree_size(levels)
        number = number % below
    return place


@lru_cache(maxsize=32)
def layout(levels: int) -> tuple[np.ndarray, ...]:
    """Places of all nodes, by depth."""
    return tuple(address(d, np.arange(FAN**d, dtype=np.int64), levels) for d in range(levels))


def levels_of(size: int, last: bool, height: int) -> int:
    """Levels of a block of ``size`` entries; ``last``: no block beside it, so it ends at its first lone node."""
    if not last:
        return height + 1
    levels = 1
    while FAN**(levels - 1) < size:
        levels += 1
    return levels


def built(entries: list[str], last: bool, height: int = BLOCK_LEVELS) -> np.ndarray:
    """The digests (rows of 32 bytes) of a block over its entries (hex), in layout order; places without a node are zero."""
    levels = levels_of(len(entries), last, height)
    places = layout(levels)
    nodes = np.zeros((tree_size(levels), 32), np.uint8)
    now = entries
    for depth in range(levels - 1, -1, -1):
        nodes[places[depth][:len(now)]] = np.frombuffer(bytes.fromhex("".join(now)), np.uint8).reshape(-1, 32)
        now = [digest("".join(now[i:i + FAN])) for i in range(0, len(now), FAN)]
    return nodes


def paths(nodes: np.ndarray, size: int, above: str, height: int = BLOCK_LEVELS) -> list[str]:
    """For each entry its siblings up to the block's root, then ``above``.

    A level is written as the siblings on the left, a point, those on the right, a slash.
    """
    levels = levels_of(size, len(nodes) != tree_size(height + 1), height)
    places = layout(levels)
    counts = [size]
    for _ in range(levels - 1):
        counts.append(-(-counts[-1] // FAN))
    found = [above]
    for depth in range(1, levels):
        count = counts[levels - 1 - depth]
        hexes = nodes[places[depth][:count]].tobytes().hex()
        down = []
        for i in range(count):
            run = i - i % FAN
            down.append(f"{hexes[64 * run:64 * i]}.{hexes[64 * (i + 1):64 * min(run + FAN, count)]}/{found[i // FAN]}")
        found = down
    return found


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its siblings give."""
    for level in path.split("/")[:-1]:
        left, right = level.split(".")
        leaf = digest(left + leaf + right)
    return leaf


# Leaves and their places ----------------------------------------------------------------------------


def leaf_digest(text: Column) -> Column:
    """The leaf of each row, with this column as its text."""
    def part(value: Column) -> Column:
        plain = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))

    return F.sha2(F.concat(*[part(text if c == "text" else F.col(c)) for c in COLUMNS]).cast("binary"), 256)


def tampered_text() -> Column:
    """The text without line feeds where the crc32 of the decimal doc_id is even."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree: the number of each within its tree and task."""
    tree, seen = None, 0
    for batch in batches:
        names = batch.column("tree").to_pylist()
        number = np.zeros(len(names), np.int64)
        at = 0
        while at < len(names):
            if names[at] != tree:
                tree, seen = names[at], 0
            end = at + 1
            while end < len(names) and names[end] == tree:
                end += 1
            number[at:end] = np.arange(seen, seen + end - at)
            seen += end - at
            at = end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "number"])


def placed(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` (tree, ...) with place, its number within its tree in this order, and size, the rows of its tree."""
    # Equal rows are apart by where they come from, so a hot one is no hot partition.
    salt = free_name(rows, "salt")
    spread = rows.withColumn(salt, F.monotonically_increasing_id())
    keys = [F.col("tree").asc(), *order, F.col(salt).asc()]
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", number long"
    written = settled(ordered.mapInArrow(_numbered, schema).withColumn("task", F.spark_partition_id()), f"{label}-ordered")
    counts = written.groupBy("tree", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("tree", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                           F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return written.join(places, ["tree", "task"]).withColumn("place", F.col("first") + F.col("number")).drop("task", "first", "number")


# Blocks ----------------------------------------------------------------------------------------------


def _block(height: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        last = table.column("size")[0].as_py() <= FAN**height
        nodes = built(table.column("digest").to_pylist(), last, height)
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([len(table)], pa.int64()),
            "tiers_done": pa.array([last]), "nodes": pa.array([nodes.tobytes()], pa.binary()), "root": pa.array([nodes[0].tobytes().hex()], pa.string()),
        })

    return run


def _tiers(entries: DataFrame, height: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each tier over entries (tree, place, size, digest), lowest first, and the roots (tree, root)."""
    tiers = []
    while True:
        cut = entries.select("tree", F.expr(f"place div {FAN**height}").alias("block"), "place", "size", "digest")
        here = settled(cut.groupBy("tree", "block").applyInArrow(_block(height), _BLOCK), f"{label}-tier{len(tiers)}")
        tiers.append(here)
        open_ones = here.where("not tiers_done")
        if open_ones.isEmpty():
            break
        # Of a tree that has more blocks: their roots, as many as the tree has blocks.
        many = open_ones.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
        entries = open_ones.select("tree", F.col("block").alias("place"), F.col("root").alias("digest")).join(many, "tree")
    roots = tiers[0].where("tiers_done").select("tree", "root")
    for tier in tiers[1:]:
        roots = roots.unionByName(tier.where("tiers_done").select("tree", "root"))
    return tiers, roots


def _down(height: int):
    """Blocks with the path of their root to the paths of their entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                each = paths(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["size"], row["above"], height)
                first = row["block"] * FAN**height
                yield pa.record_batch({"tree": pa.array([row["tree"]] * len(each), pa.string()), "block": np.arange(first, first + len(each)),
                                       "above": pa.array(each, pa.string())})

    return run


def _proved(height: int):
    """The rows of one block with the digest of their siblings and the root that they fold to."""
    def run(key: tuple, leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        block = blocks.slice(0, 1).to_pylist()[0]
        each = paths(np.frombuffer(block["nodes"], np.uint8).reshape(-1, 32), block["size"], block["above"], height)
        places = (leaves.column("place").to_numpy() - block["block"] * FAN**height).tolist()
        return pa.table({
            "doc_id": leaves.column("doc_id"), "leaf": leaves.column("digest"), "tree": leaves.column("tree"),
            "proof_sha256": pa.array([digest(each[i].replace(".", "").replace("/", "")) for i in places], pa.string()),
            "folded_root": pa.array([folded(s, each[i]) for i, s in zip(places, leaves.column("presented").to_pylist())], pa.string()),
        })

    return run


@dataclass
class Manifest:
    """``leaves`` (tree, place, doc_id, digest), blocks of each tier of the sources' trees and of the top tree, ``subroots``
    (tree, source, subroot, entry: its place in the top tree), the root (None: no rows) and the levels in a block."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None
    height: int


def manifest(docs: DataFrame, presented: Column | None = None, height: int = BLOCK_LEVELS) -> Manifest:
    """Build the manifest. ``presented``: a text to verify each row by, whose leaf is kept beside the row's own. ``height``: levels in a block above its entries."""
    if height < 1:
        raise ValueError("a block has one level above its entries at least")
    # A source's tree is named by its text behind a mark, so that null has a name that comes first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    other = F.lit(None).cast("string") if presented is None else leaf_digest(presented)
    hashed = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("digest"), other.alias("presented"))
    leaves = settled(placed(settled(hashed, "op13-hashed"), [F.col("doc_id").asc_nulls_last(), F.col("digest").asc()], "op13"), "op13-leaves")
    tiers, subroots = _tiers(leaves, height, "op13")
    subroots = settled(subroots, "op13-subroots")
    entries = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), [F.col("name").asc()], "op13-top")
    entries = settled(entries, "op13-entries")
    top, root = _tiers(entries, height, "op13-top")
    named = subroots.join(entries.select(F.col("name").alias("tree"), F.col("place").alias("entry")), "tree")
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    one = root.first()
    return Manifest(leaves, tiers, top, named.select("tree", source.alias("source"), F.col("root").alias("subroot"), "entry"), one and one["root"], height)


_PATHS = "tree string, block long, above string"


def _entry_paths(tier: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Paths of a tier's entries (tree, block: the entry), from those of its blocks' roots (tree, block, above)."""
    return tier.join(above, ["tree", "block"]).select("tree", "block", "size", "nodes", "above").mapInArrow(_down(height), _PATHS)


def _lowest_paths(tiers: list[DataFrame], above: DataFrame, height: int, label: str) -> DataFrame:
    """Paths (tree, block, above) of the lowest blocks' roots, from those of the trees' roots (tree, above)."""
    path = None
    for k in range(len(tiers) - 1, -1, -1):
        # Trees that end at this tier start here; the others come down from the tier over it.
        ends = tiers[k].where("tiers_done").select("tree", "block").join(above, "tree")
        path = ends if path is None else ends.unionByName(path)
        if k:
            path = settled(_entry_paths(tiers[k], path, height), f"{label}-paths{k}")
    return path


def proofs(made: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the presented row, else the row itself) and verified, for every leaf."""
    height = made.height
    top_root = made.top[-1].where("tiers_done").select("tree", F.lit("").alias("above"))
    of_subroots = _entry_paths(made.top[0], _lowest_paths(made.top, top_root, height, "op13-top"), height)
    above = settled(made.subroots.join(of_subroots.select(F.col("block").alias("entry"), "above"), "entry").select("tree", "above"), "op13-above")
    blocks = made.tiers[0].join(_lowest_paths(made.tiers, above, height, "op13"), ["tree", "block"]).select("tree", "block", "size", "nodes", "above")
    leaves = made.leaves.select("tree", F.expr(f"place div {FAN**height}").alias("block"), "place", "doc_id", "digest", F.coalesce("presented", "digest").alias("presented"))
    rows = leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(
        _proved(height), "doc_id long, leaf string, tree string, proof_sha256 string, folded_root string")
    root = F.lit(made.root).cast("string")
    return rows.join(made.subroots.select("tree", "subroot"), "tree").select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def write_manifest(made: Manifest, folder: str) -> None:
    """Keep a manifest as Parquet below ``folder``: leaves, blocks (with the tier and whose tree), subroots."""
    made.leaves.select("tree", "place", "size", "doc_id", "digest", "presented").write.parquet(f"{folder}/leaves")
    kept = None
    for top, tiers in ((False, made.tiers), (True, made.top)):
        for k, tier in enumerate(tiers):
            here = tier.select(F.lit(top).alias("top"), F.lit(k).alias("tier"), F.lit(made.height).alias("height"), "*")
            kept = here if kept is None else kept.unionByName(here)
    kept.write.partitionBy("top", "tier").parquet(f"{folder}/blocks")
    made.subroots.write.parquet(f"{folder}/subroots")


def read_manifest(spark: SparkSession, folder: str) -> Manifest:
    """The manifest that ``write_manifest`` kept."""
    blocks = spark.read.schema(f"{_BLOCK}, height int, top boolean, tier int").parquet(f"{folder}/blocks")
    facts = blocks.groupBy("top").agg(F.max("tier").alias("tiers"), F.max("height").alias("height")).collect()
    number = {r["top"]: r["tiers"] + 1 for r in facts}
    tiers, top = ([blocks.where((F.col("top") == which) & (F.col("tier") == k)) for k in range(number.get(which, 1))] for which in (False, True))
    one = top[-1].where("tiers_done").select("root").first()
    return Manifest(spark.read.parquet(f"{folder}/leaves"), tiers, top, spark.read.parquet(f"{folder}/subroots"), one and one["root"],
                    facts[0]["height"] if facts else BLOCK_LEVELS)
