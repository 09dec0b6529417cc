"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from notelake.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    form, out = {}, {}
    for w, n in counts.items():
        others = sorted((o for o in counts if near(w, o)), key=lambda o: (-counts[o], o))
        form[w] = others[0] if others and counts[others[0]] >= ratio * n else None
        out[w] = [form[w], None, n, len(others), form[w] and counts[form[w]]]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def counted(pairs, every=31):
    """As the rule for words is written, one run at a time."""
    seen = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def lexicon(seed, n, letters="abcdé", sizes=(7, 9)):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes))) for _ in range(n)})


@pytest.mark.parametrize("pairwise", [0, 512])
@pytest.mark.parametrize("leaf", [4, 96])
def test_pairs_of_a_cell(monkeypatch, pairwise, leaf):
    monkeypatch.setattr(S, "PAIRWISE", pairwise)
    monkeypatch.setattr(S, "LEAF_WORDS", leaf)
    words = lexicon(1, 900) + ["a" * 600, "a" * 599 + "b", "a" * 601]
    for length in (7, 8, 9, 600, 601):
        same, shorter = ([w for w in words if len(w) == n] for n in (length, length - 1))
        for mine in (same, shorter):
            if mine and same:
                i, j = S.near_pairs(S.letters_of(mine), S.letters_of(same), mine is shorter)
                found = sorted(zip(i.tolist(), j.tolist()))
                assert found == [(x, y) for x, a in enumerate(mine) for y, b in enumerate(same) if near(a, b)]


def test_vectors_are_in_reach_of_their_neighbours():
    words = [w for w in lexicon(2, 400, "abcdefgh", (8, 8))]
    letters = S.letters_of(words)
    vectors = S.vectors_of(letters)
    tree = S.Tree(vectors, 5)
    leaf_of = {i: leaf for leaf, members in enumerate(tree.members) for i in members.tolist()}
    reached = {(leaf, i) for leaf, some in tree.reached(vectors, 1, 1) for i in some.tolist()}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if near(a, b):
                assert (leaf_of[j], i) in reached
    assert sorted(leaf_of) == list(range(len(words)))
    assert {(leaf_of[i], i) for i in leaf_of} == {(leaf, i) for leaf, some in tree.reached(vectors, 0, 0) for i in some.tolist()}


# Cells of all sizes: everything in one, many, and fitted on a few words only.
@pytest.mark.parametrize("sample,cell_words", [(1 << 18, 1 << 14), (1 << 18, 40), (60, 40)])
def test_groups_are_those_of_a_comparison_of_all(spark, sample, cell_words):
    rnd = random.Random(5)
    counts = {w: rnd.choice((2, 3, 5, 30, 400, 6000)) for w in lexicon(3, 500) + lexicon(4, 150, "abcdefghijklmnopqrstuvwxyzàü", (7, 12))}
    counts |= {"anagram": 50, "anagarm": 50, "anagrams": 600, "anagramz": 600}
    counts |= {"".join(p): 2 for p in {tuple(rnd.sample("aabbccdd", 8)) for _ in range(200)}}
    rows = S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5), sample=sample, cell_words=cell_words).collect()
    assert len(rows) == len(counts)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == brute(counts)


def test_chains_lead_to_their_end(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"]
    counts = {w: 10**k for k, w in enumerate(chain)}
    rows = {r.word: r for r in S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert all(rows[w].root == chain[-1] for w in chain)
    assert [rows[w].form for w in chain] == chain[1:] + [None]


def test_words_of_documents(spark, documents, hard_pairs):
    rnd = random.Random(9)
    words = lexicon(6, 60) + ["Straße", "ÀÉÎÕÜñ×÷", "naïveté", "Übergröße", "l'appartement", "déjàvuencore"]
    pairs = hard_pairs + [(100 + k, "".join(rnd.choice(words) + rnd.choice((" ", ".", "\n", "-", "日", "1", "Ā")) for _ in range(60))) for k in range(40)]
    pairs += [pairs[-1], (None, words[0] + " " + words[0]), (7, "x" * 3000 + " " + "y" * 20 + " " + "y" * 20 + " " + "x" * 3000)]
    docs = documents(pairs)
    for every in (31, 2, None):
        got = {r.word: r.n for r in S.word_counts(docs, noise_every=every).collect()}
        assert got == counted(pairs, every)
    rows = S.spelling_groups(S.word_counts(docs, noise_every=31)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == brute(counted(pairs))


def test_no_words(spark, documents):
    assert S.spelling_groups(S.word_counts(documents([(1, None), (2, ""), (3, "short words")]))).collect() == []
    assert S.spelling_groups(S.word_counts(documents([]).limit(0))).collect() == []
    with pytest.raises(ValueError):
        S.spelling_groups(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_letters_shared_are_a_product_of_rows():
    vectors = S.vectors_of(S.letters_of(["aabbccc", "abbbccd"]))
    rows = S._unary(vectors, vectors.max(axis=0))
    assert rows[0] @ rows[1] == np.minimum(vectors[0], vectors[1]).sum()
