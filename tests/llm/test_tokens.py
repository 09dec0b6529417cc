"""Token files, edit-aware counts and the piece lattice against the tokenizers themselves and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from notelake.llm.chunks import encoder, texts_of, token_bounds  # noqa: E402
from notelake.llm.edited_counts import ChunkTree, _byte_edits, edited_token_counts, edited_total  # noqa: E402
from notelake.llm.piece_lattice import decode_ids, lattice, nbest_encode, segmented  # noqa: E402
from notelake.llm.token_files import read_token_files, write_token_files  # noqa: E402
from notelake.session import scratch_path  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ATOMS = [" ", "  ", "\n", "\t", " ", "　", "\x85", "\x1f", "the", "a", "é", "ü", "日", "'s", "12", "!!", "<|endoftext|>", "\r\n", "😀"]


def texts(seed, n, size):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_chunks_give_the_tokenizers_ids():
    plain, some = tokenizers.Tokenizer.from_file(BPE), texts(1, 3000, 30)
    raw, offsets = texts_of(some)
    ids, sizes, starts = encoder(BPE).encode(raw, offsets)
    bounds = token_bounds(sizes, starts, offsets)
    for i, text in enumerate(some):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files(spark, documents, hard_pairs):
    plain = tokenizers.Tokenizer.from_file(BPE)
    root = scratch_path(spark, "test-tokens")
    write_token_files(documents(hard_pairs), root, BPE)
    got = read_token_files(spark, root).orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert [r.start for r in got] == np.append(0, np.cumsum([len(x) for x in ids]))[:-1].tolist()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is None, i)) and len(got) == len(hard_pairs)
    want = sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in hard_pairs)
    assert sorted(map(tuple, ids)) == want
    digests = read_token_files(spark, root, digest=True).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want)


def test_no_documents_make_no_tokens(spark, documents):
    root = scratch_path(spark, "test-no-tokens")
    write_token_files(documents([]).limit(0), root, BPE)
    assert read_token_files(spark, root).count() == 0


def test_edits_change_counts_as_encoding_anew_does():
    plain, encode, rnd = tokenizers.Tokenizer.from_file(BPE), encoder(BPE), random.Random(2)
    for text in texts(3, 1500, 60):
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(2 * rnd.randint(1, 3)))
        edits = [{"start": a, "length": b - a, "replacement": "".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 3)))} for a, b in zip(cuts[::2], cuts[1::2])]
        new, at = "", 0
        for e in edits:
            new, at = new + text[at:e["start"]] + e["replacement"], e["start"] + e["length"]
        new += text[at:]
        raw, offsets = texts_of([text])
        _, sizes, starts = encode.encode(raw, offsets, counts_only=True)
        total, _ = edited_total(raw.tobytes(), starts.tolist(), ChunkTree(sizes), _byte_edits(text, edits), encode)
        assert total == len(plain.encode(new, add_special_tokens=False).ids)


def test_edited_counts_of_documents(documents, hard_pairs):
    docs = documents(hard_pairs)
    front = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("new ").alias("replacement")))
    nothing = docs.withColumn("edits", F.lit(None).cast("array<struct<start:int,length:int,replacement:string>>"))
    for r in edited_token_counts(nothing, BPE).collect():
        assert r.n_tokens == r.n_tokens_edited and r.n_encoded_again == 0
    plain = tokenizers.Tokenizer.from_file(BPE)
    counts = sorted(r.n_tokens_edited for r in edited_token_counts(docs.withColumn("edits", front), BPE).collect())
    assert counts == sorted(len(plain.encode("new " + (t or ""), add_special_tokens=False).ids) for _, t in hard_pairs)
    with pytest.raises(ValueError):
        _byte_edits("abc", [{"start": 0, "length": 2, "replacement": ""}, {"start": 1, "length": 1, "replacement": ""}])


def brute_nbest(pieces, text, n):
    _, ending = pieces._arcs((" " + text).encode())
    best = [[0.0]]
    for here in ending[1:]:
        best.append(sorted((s + before for i, _, s in here for before in best[i]), reverse=True)[:n])
    return best[-1]


@pytest.mark.parametrize("n", [1, 3, 6])
def test_nbest_paths(n):
    pieces, some = lattice(PIECES), [*texts(4, 250, 12), "x" * 70 + "the" * 20, ""]
    for text, found in zip(some, segmented(pa.array(some), pieces, n)):
        assert [s for s, _ in found] == pytest.approx(brute_nbest(pieces, text, n))
        assert len({tuple(ids.tolist()) for _, ids in found}) == len(found)
        assert all(pieces.decode(ids).decode() == text for _, ids in found)


def test_runs_of_spaces():
    """Against a lattice of all the model's pieces, built from id_to_piece and get_score alone."""
    read = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    usual = [i for i in range(read.get_piece_size()) if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i))]
    scores = {read.id_to_piece(i): (i, read.get_score(i)) for i in usual}
    barred = min(s for _, s in scores.values() if s > -1e8) - 10

    def best(text, n):
        marked = "▁" + text.replace(" ", "▁")
        paths = [[(0.0, ())]]
        for j in range(1, len(marked) + 1):
            arcs = [(i, *scores[marked[i:j]]) for i in range(j) if marked[i:j] in scores]
            if all(i < j - 1 for i, _, _ in arcs):
                byte_ids = [k for b in marked[j - 1].encode() for k in range(read.get_piece_size()) if read.is_byte(k) and read.id_to_piece(k) == f"<0x{b:02X}>"]
                paths.append(sorted(((s + max(t, barred), (*ids, k)) for i, k, t in arcs for s, ids in paths[i]), reverse=True))
                paths[j] += [(s + barred, (*ids, *byte_ids)) for s, ids in paths[j - 1]]
            else:
                paths.append([(s + max(t, barred), (*ids, k)) for i, k, t in arcs for s, ids in paths[i]])
            # Of equal paths all but those past 4,000 are kept.
            paths[j] = sorted(paths[j], key=lambda p: -p[0])[:4000]
        return paths[-1]

    pieces = lattice(PIECES)
    some = [f"a{' ' * k}b" for k in range(2, 21)] + [" " * k + "return x" for k in (1, 2, 3, 4, 8, 16, 20)] + ["a   ", "   ", "if x:\n        y  = 1\n\n    z", "é   日  ü"]
    for text, found in zip(some, segmented(pa.array(some), pieces, 3)):
        want = best(text, 3)
        ids_of = {ids: s for s, ids in want}
        assert [s for s, _ in found] == [s for s, _ in want[:3]], text
        assert all(ids_of.get(tuple(ids.tolist()), s) == s for s, ids in found)
        assert len({tuple(ids.tolist()) for _, ids in found}) == len(found)
        assert all(pieces.decode(ids).decode() == text for _, ids in found)
    (long,) = segmented(pa.array(["a" + " " * 3000 + "b"]), pieces, 3)
    assert len(long) == 3 and pieces.decode(long[0][1]).decode() == "a" + " " * 3000 + "b"
    (first,) = segmented(pa.array(["a   b"]), pieces, 1)
    assert [read.id_to_piece(i) for i in first[0][1].tolist()] == ["▁a", "▁▁", "▁b"]


def test_nbest_documents_round_trip(documents, hard_pairs):
    encoded = nbest_encode(documents(hard_pairs), PIECES, n=2)
    assert sorted(r.text for r in decode_ids(encoded.where("rank = 1"), PIECES).collect()) == sorted(t or "" for _, t in hard_pairs)
    digest = nbest_encode(documents(hard_pairs), PIECES, n=3, digest=True).collect()
    assert all(r.round_trip for r in digest) and {r.rank for r in digest} == {1, 2, 3}
    assert nbest_encode(documents([]).limit(0), PIECES).count() == 0
