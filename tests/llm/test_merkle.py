"""Merkle manifests against trees hashed node by node."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import merkle as M
from notelake.session import scratch_path


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    """Per level (nodes left, nodes right)."""
    for nodes in tree[:-1]:
        run = at - at % 3
        yield nodes[run:at], nodes[at + 1:run + 3]
        at //= 3


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(((r[0] is None, r[0], leaf(r), r) for r in rows if r[1] == source), key=lambda x: x[:3])
        trees[source] = mine, levels([x[2] for x in mine])
    top = levels([t[-1][0] for _, t in trees.values()])
    out = []
    for entry, (mine, tree) in enumerate(trees.values()):
        for at, (_, doc_id, given, row) in enumerate(mine):
            path = [*siblings(tree, at), *siblings(top, entry)]
            text = row[4]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now = leaf((*row[:4], text))
            for left, right in path:
                now = h("".join([*left, now, *right]))
            proof = h("".join("".join([*left, *right]) for left, right in path))
            out.append((doc_id, given, tree[-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def table(spark, rows):
    ddl = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    return spark.createDataFrame(rows, ddl).select("*", F.lit(1).alias("place"), F.lit("x").alias("tree"), F.lit(0).alias("salt")).repartition(5)


def sample(n, sources, seed=1):
    rnd = random.Random(seed)
    texts = [None, "", "one\ntwo", "plain", "é\n日本\n", "\n", "x" * 5000]
    rows = [(i, rnd.choice(sources), rnd.choice(("en", None, "")), rnd.choice((None, -3, 12)), rnd.choice(texts)) for i in rnd.sample(range(10 * n), n)]
    return rows + rows[:4] + [(rows[0][0], rows[0][1], "en", 1, "another")] + [(None, s, None, None, "no id\n") for s in sources[:2] * 2]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("height", [1, 2, 8])
@pytest.mark.parametrize("sources", [["a"], [None, "", "a", "=", "b", "é", "z", "zz", "日", "c", "d"]])
def test_proofs_are_those_of_trees_hashed_node_by_node(spark, height, sources):
    rows = sample(120, sources)
    got = M.proofs(M.manifest(table(spark, rows), presented=M.tampered_text(), height=height)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_trees_of_all_shapes(n):
    entries = [h(str(i)) for i in range(n)]
    want = levels(entries)
    for height in (4, 8):
        nodes = M.built(entries, True, height)
        assert nodes[0].tobytes().hex() == want[-1][0]
        for at, path in enumerate(M.paths(nodes, n, "", height)):
            assert path == "".join(f"{''.join(a)}.{''.join(b)}/" for a, b in siblings(want, at))
            assert M.folded(entries[at], path) == want[-1][0]


def test_the_layout_is_the_recursive_one():
    def recursive(nodes):
        """Nodes by level, root first, to their order: the upper half of the levels, then the trees below, left to right."""
        if len(nodes) == 1:
            return list(nodes[0])
        upper = len(nodes) // 2
        out = recursive(nodes[:upper])
        width = len(nodes[upper])
        for k in range(width):
            out += recursive([level[k * len(level) // width:(k + 1) * len(level) // width] for level in nodes[upper:]])
        return out

    for n in range(1, 8):
        order = recursive([[(d, i) for i in range(3**d)] for d in range(n)])
        for d in range(n):
            assert [order[p] for p in M.address(d, np.arange(3**d), n)] == [(d, i) for i in range(3**d)]
        assert M.tree_size(n) == len(order)


def test_a_changed_row_is_found_with_a_kept_manifest(spark):
    rows = sample(80, ["a", "b", None])
    made = M.manifest(table(spark, rows), height=2)
    folder = scratch_path(spark, "test-manifest")
    M.write_manifest(made, folder)
    again = M.read_manifest(spark, folder)
    assert again.root == made.root
    assert sorted(map(tuple, M.proofs(again).collect()), key=key) == sorted(map(tuple, M.proofs(made).collect()), key=key)
    assert M.proofs(again).where("not verified").isEmpty()
    other = M.manifest(table(spark, rows[:-1]), height=2)
    assert other.root != made.root


def test_no_rows(spark):
    made = M.manifest(table(spark, []).limit(0))
    assert made.root is None and M.proofs(made).collect() == []
    with pytest.raises(ValueError):
        M.manifest(table(spark, []), height=0)
