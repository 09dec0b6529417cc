"""Strings in regular patterns are told apart: sums of powers modulo 2**64 give Thue-Morse strings one hash."""

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import kernels as K
from notelake.llm.ngram_join import token_sets

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from notelake.llm.chunks import ChunkEncoder, encoder, texts_of, token_bounds  # noqa: E402


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (16, 64, 96, 97, 1024, 2048)]


@pytest.mark.parametrize("one, two", PAIRS)
def test_two_words(one, two):
    raw, offsets = K.utf8(pa.array([one, two, one]))
    a, b, c = K.stretch_hashes(raw, offsets[:-1], offsets[1:])
    assert a != b and a == c
    batch = pa.record_batch({"text": pa.array([one, two, f"{one} x", f"{two} x"])})
    tokens, firsts = token_sets(batch, 5)
    assert len(set(tokens.tolist())) == 4 and np.diff(firsts).tolist() == [1, 1, 1, 1]


@pytest.mark.parametrize("words", [False, True])
def test_ids_are_those_of_the_word_itself(words):
    path = public_tokenizers.path("word_bpe_49k.json" if words else "byte_bpe_50k.json")
    texts = [t for pair in PAIRS for t in pair]
    raw, offsets = texts_of(texts)
    ids, sizes, starts = encoder(path, words).encode(raw, offsets)
    bounds = token_bounds(sizes, starts, offsets)
    for i, want in enumerate(tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want.ids


def test_equal_hashes_do_not_share_ids(monkeypatch):
    monkeypatch.setattr(K, "stretch_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    path = public_tokenizers.path("byte_bpe_50k.json")
    raw, offsets = texts_of(["some words", "other words of it", "some words"])
    ids, sizes, starts = ChunkEncoder(path).encode(raw, offsets)
    bounds = token_bounds(sizes, starts, offsets)
    plain = tokenizers.Tokenizer.from_file(path)
    for i, text in enumerate(["some words", "other words of it", "some words"]):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
