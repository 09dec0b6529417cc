"""Packing against the tokenizer, a plain best fit, and what a sequence may hold."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from notelake.llm.chunks import encoder, texts_of, token_bounds  # noqa: E402
from notelake.llm.packing import Packer, packed, sequences  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
ATOMS = [" ", "  ", "\n", "\t", " ", "　", "\x85", "the", "a", "A", "é", "É", "日", "'s", "'", "'RE", "12", "!!", "<|endoftext|>", "\r\n", "😀",
         "J̌", "ß", "×", "-", "_", "İ", "K", "́", "<", "̸", "…", "."]


@pytest.mark.parametrize("special", [True, False])
def test_word_chunks_give_the_tokenizers_ids(special):
    rnd, plain = random.Random(3), tokenizers.Tokenizer.from_file(WORDS)
    atoms = ATOMS if special else [a for a in ATOMS if "|" not in a]
    some = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    raw, offsets = texts_of(some)
    ids, sizes, starts = encoder(WORDS, words=True).encode(raw, offsets)
    bounds = token_bounds(sizes, starts, offsets)
    for i, want in enumerate(plain.encode_batch(some, add_special_tokens=False)):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want.ids, some[i]


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_the_packer_is_a_plain_best_fit_in_bounded_space(open_bins):
    rnd = random.Random(open_bins)
    packer, bins, closed = Packer(40, open_bins), [], []
    for k in range(600):
        n = rnd.randint(1, 40)
        out = packer.add(n, k)
        # The same by a search of all bins: (free, pieces).
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            b = [40, []]
            if n < 40 and len(bins) == open_bins:
                closed.append(min(bins, key=lambda b: b[0]))
                bins.remove(closed[-1])
            bins.append(b)
        b[0] -= n
        b[1].append(k)
        if b[0] == 0:
            bins.remove(b)
            closed.append(b)
        assert sorted(s for s, same in packer.by_free.items() for _ in same) == sorted(b[0] for b in bins)
        assert packer.n_open == len(bins) <= open_bins
        assert (out is None) == (not closed or closed[-1] is None)
        if out is not None:
            assert 40 - sum(x for x, _ in out) == closed.pop()[0]
    assert [sum(n for n, _ in c) for c in packer.drained()] == sorted((40 - b[0] for b in bins), reverse=True)


def _check(rows, pairs, capacity):
    plain = tokenizers.Tokenizer.from_file(WORDS)
    want = []
    for i, text in pairs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(i, k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(np.array(ids[k:k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == np.append(0, np.cumsum([n for _, n in places]))[:-1].tolist()
        assert sum(n for _, n in places) <= capacity
    return len(held), -(-sum(w[3] for w in want) // capacity)


def test_pieces_and_sequences(spark, documents, hard_pairs):
    for capacity, bins, fan_in in ((64, 4, 2), (4096, 1024, 16)):
        rows = packed(documents(hard_pairs).repartition(7), WORDS, 1, capacity, bins, fan_in, words=True).collect()
        used, least = _check(rows, hard_pairs, capacity)
        assert used <= least * 1.1 + 1


def test_ids_come_back_whole(spark, documents, hard_pairs):
    plain = tokenizers.Tokenizer.from_file(WORDS)
    pieces = packed(documents(hard_pairs), WORDS, 1, capacity=256, with_ids=True)
    whole = {}
    for s in sequences(pieces).collect():
        ids = np.frombuffer(s.ids, "<u4").tolist()
        assert len(ids) == s.n_tokens <= 256
        for d in s.docs:
            whole.setdefault((d.doc_id, d.piece), []).append(ids[d.offset:d.offset + d.length])
    texts = {}
    for i, t in hard_pairs:
        texts.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    for (i, piece), found in whole.items():
        assert sorted(found) == sorted(x[256 * piece:256 * piece + 256] for x in texts[i] if len(x) > 256 * piece)


def test_no_documents_make_no_sequences(spark, documents):
    assert packed(documents([]).limit(0), WORDS, 1).count() == 0
    with pytest.raises(ValueError):
        packed(documents([]), WORDS, 1, open_bins=0)
