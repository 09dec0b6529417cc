"""Substring, suffix-array and n-gram operators against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import ngram_join
from notelake.llm.ngram_join import ngram_components, without_near_duplicates
from notelake.llm.substring_dedup import repeat_levels, substring_dedup
from notelake.llm.suffix_dedup import suffix_array, suffix_dedup, without_repeated_strings

LAST = 1 << 62


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_substring(pairs, window):
    least = {}
    for i, t in pairs:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            least[key] = min(least.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in pairs:
        w, gone = words_of(t), set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(documents, hard_pairs, window):
    got = substring_dedup(documents(hard_pairs), window).collect()
    assert ordered(got) == ordered(brute_substring(hard_pairs, window))


def test_substring_levels(documents, hard_pairs):
    levels = {(r.doc_id, r.length): r.n_windows for r in repeat_levels(documents(hard_pairs), 30).collect()}
    # The copy of 130 words repeats at every doubled length that fits.
    assert levels[11, 30] == 101 and levels[11, 60] == 71 and levels[11, 120] == 11 and (11, 240) not in levels


def brute_suffix(pairs, length):
    """Repeated rows count as one; ids decide, rows without id come last."""
    texts = {(LAST if i is None else i, (t or "")): (t or "").encode() for i, t in pairs}
    first = {}
    for (i, t), b in sorted(texts.items()):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k:k + length], (i, t, k))
    out = []
    for i, t in pairs:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] != (LAST if i is None else i, t or "", k):
                gone.update(range(k, k + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, bytes(x for k, x in enumerate(b) if k not in gone)))
    return out


@pytest.mark.parametrize("crowd", [2048, 1])
def test_suffix_dedup(documents, hard_pairs, crowd, monkeypatch):
    from notelake.llm import suffix_dedup as module

    plain = module.repeated_strings
    monkeypatch.setattr(module, "repeated_strings", lambda docs, length: plain(docs, length, crowd=crowd, portion=500))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup(documents(hard_pairs), 100).collect()]
    assert ordered(got) == ordered(brute_suffix(hard_pairs, 100))


def test_suffix_array():
    rnd = np.random.default_rng(0)
    for _ in range(400):
        s = rnd.integers(1, rnd.integers(2, 6), rnd.integers(0, 50))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_rewritten_texts_keep_columns_and_whole_characters(documents, hard_pairs):
    docs = documents(hard_pairs)
    cut = without_repeated_strings(docs, 100)
    assert cut.schema == docs.schema
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert kept[11] == "" and kept[6] is None and "�" not in kept[15]


def brute_components(pairs):
    sets = []
    for _, t in pairs:
        w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(pairs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = defaultdict(lambda: LAST)
    for i, (doc_id, _) in enumerate(pairs):
        least[root(i)] = min(least[root(i)], LAST if doc_id is None else doc_id)
    return [(doc_id, len(sets[i]), None if least[root(i)] == LAST else least[root(i)]) for i, (doc_id, _) in enumerate(pairs)]


@pytest.mark.parametrize("frequent, block_nodes", [(64, 256), (2, 4)])
def test_ngram_components(documents, hard_pairs, frequent, block_nodes):
    rnd = random.Random(5)
    words = [f"v{rnd.randint(0, 900)}" for _ in range(150)]
    pairs = list(hard_pairs)
    for k in range(60):  # a family around the threshold: many pairs link, many do not
        copy = list(words)
        for _ in range(rnd.randint(1, 5)):
            copy[rnd.randrange(150)] = f"u{rnd.randint(0, 999)}"
        pairs.append((100 + k, " ".join(copy)))
    got = ngram_components(documents(pairs), frequent=frequent, block_nodes=block_nodes)
    assert ordered(got.select("doc_id", "n_shingles", "component_id").collect()) == ordered(brute_components(pairs))


def test_keys_inside_a_family_make_no_rows(documents, monkeypatch):
    rnd = random.Random(7)
    pairs, rows = [], defaultdict(int)
    for family in range(2):  # both spread over several blocks, and not connected as a whole
        words = [f"f{family}w{rnd.randint(0, 900)}" for _ in range(150)]
        for k in range(40):
            copy = list(words)
            for _ in range(rnd.randint(3, 6)):
                copy[rnd.randrange(150)] = f"u{rnd.randint(0, 9)}"
            pairs.append((100 * family + k, " ".join(copy)))
    plain = ngram_join.settled

    def counted(df, label, *used_up):
        out = plain(df, label, *used_up)
        rows[label] += out.count() if label in ("op4-open", "op4-block-pairs", "op4-parts") else 0
        return out

    monkeypatch.setattr(ngram_join, "settled", counted)
    got = ngram_components(documents(pairs), block_nodes=4).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute_components(pairs))
    assert len({r.component_id for r in got}) > 2
    # What a family has in several blocks meets by its blocks, not by the keys that all of it shares.
    assert rows["op4-open"] == rows["op4-block-pairs"] == 0 < rows["op4-parts"]


def test_survey_names_only_documents_with_shared_tokens():
    tokens = [np.array([3, 8, 9], np.uint32), np.array([8, 20], np.uint32), np.array([50], np.uint32)]
    places = [np.array([7, 7, 2], np.uint16), np.array([0, 1], np.uint16), np.array([4], np.uint16)]
    group = pa.table({
        "portion": [11, 12, 13], "at": pa.array([1000, 2, 5], pa.int32()),
        "tokens": [ngram_join._planes(np.diff(t, prepend=np.uint32(0))) for t in tokens], "places": [ngram_join._planes(p) for p in places],
    })
    found = ngram_join._shared_counts(group)
    assert found.column("portion").to_pylist() == [11, 12] and sum(map(len, found.column("counts").to_pylist())) == 8
    total = [ngram_join._total_counts(found.slice(i, 1)).column("shared").to_pylist() for i in (0, 1)]
    assert [i for i, c in enumerate(total[0]) if c] == [7] and len(total[0]) == 1000 and total[1] == [1, 0]


def test_one_of_each_group_stays(documents, hard_pairs):
    docs = documents(hard_pairs)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and not {10, 11, *range(30, 36)} & set(ids) and {6, 7, 8} <= set(ids)


def test_empty_tables(documents):
    docs = documents([]).limit(0)
    assert substring_dedup(docs).count() == suffix_dedup(docs).count() == ngram_components(docs).count() == 0
    assert without_near_duplicates(docs).count() == without_repeated_strings(docs).count() == 0
