"""Fingerprints, decontamination, quality, chat rotation and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.llm import decontamination
from notelake.llm.chat_perspectives import rendered, rotated
from notelake.llm.decontamination import decontaminated, lcs_length, leaks
from notelake.llm.fingerprints import fingerprints
from notelake.llm.quality import gumbel_top_k, quality_filter, resampled


def prose(rnd, n, stem="w", vocabulary=400):
    return " ".join(f"{stem}{rnd.randint(0, vocabulary)}" for _ in range(n))


def test_fingerprints(documents, hard_pairs):
    pairs = [p for p in hard_pairs if p[0] is not None]
    got = fingerprints(documents(pairs), samples=32, block=4).collect()
    assert len(got) == len(pairs)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    texts = {i: t or "" for i, t in pairs}
    once = sorted((i for i, k in Counter(i for i, _ in pairs).items() if k == 1), reverse=True)
    order = sorted((i for i, _ in pairs), reverse=True)

    def jaccard(a, b):
        p, q = Counter(a.split()), Counter(b.split())
        return sum((p & q).values()) / max(1, sum((p | q).values())) if p or q else 1.0

    wrong = []
    for i in once:
        following = texts[order[(order.index(i) + 1) % len(order)]]
        n = len(texts[i])
        edited = texts[i][:n - n // 3] + following[:n // 3]
        (r,) = by_id[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        wrong += [jaccard(texts[i], edited) - r.near_edited, jaccard(texts[i], following) - r.near_next]
    assert abs(sum(wrong) / len(wrong)) < 0.06 and max(map(abs, wrong)) < 0.4
    assert by_id[10][0].fingerprint == by_id[11][0].fingerprint != by_id[12][0].fingerprint
    assert by_id[6][0].fingerprint == by_id[7][0].fingerprint == by_id[8][0].fingerprint


def test_fingerprint_edges(documents):
    assert fingerprints(documents([]).limit(0), samples=4).count() == 0
    (alone,) = fingerprints(documents([(None, "a b c d e f")]), samples=4).collect()
    assert alone.doc_id is None and alone.near_next == 1.0


def test_fingerprints_without_the_values_that_cannot_be_smallest(documents, hard_pairs):
    """Whether few or nearly all values are left out, and whether rows are sampled again, the samples are those of all values."""
    docs = documents(hard_pairs)
    every, usual, few = (sorted(fingerprints(docs, samples=8, block=4, reach=reach).collect(), key=repr) for reach in (1e9, 24.0, 0.5))
    assert every == usual == few


def test_lcs_length():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]


@pytest.fixture(scope="module")
def leak_case(spark):
    rnd = random.Random(3)
    items = [(k, prose(rnd, rnd.randint(15, 60), f"q{k}x", 60)) for k in range(20)] + [(98, None), (99, "")]
    docs, want = [(900, None), (901, ""), (902, "   ")], set()
    for k in range(120):
        words = prose(rnd, rnd.randint(1, 500)).split()
        if k % 4 == 0:
            item, text = items[k % 20][0], items[k % 20][1].split()
            if k % 8 == 0:  # paraphrased: one word in six replaced
                text = [w if j % 6 else f"other{j}" for j, w in enumerate(text)]
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() if k % 3 else w + "," for w in text]
            want.add((k, item))
        docs.append((k, " ".join(words)))
    return items, docs, want


def test_leaks(spark, documents, leak_case):
    items, docs, want = leak_case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(documents(docs), benchmark).collect()}
    assert found == want
    clean = decontaminated(documents(docs), benchmark)
    assert clean.columns == documents(docs).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_of_empty_tables(spark, documents, leak_case):
    items, docs, _ = leak_case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert leaks(documents([]).limit(0), benchmark).count() == 0
    assert leaks(documents(docs), benchmark.limit(0)).count() == 0


def test_leaks_in_large_groups(spark, documents):
    """An item in half of all documents, one whose words are in all of them, and a document copied to a third of the rows, with a passage and a paraphrase."""
    rnd = random.Random(11)
    often, stops, copied = prose(rnd, 30, "often"), " ".join(f"stop{k}" for k in range(8)), prose(rnd, 40, "copied")
    told = [f"told{k}" for k in range(20)]
    items = [(1, often), (2, stops), (3, copied), (4, " ".join(told))]
    docs, want = [], set()
    # Of item 4 the last third and a third of the others are left.
    told = [w if k % 3 == 0 or k > 13 else f"other{k}" for k, w in enumerate(told)]
    copy = f"{prose(rnd, 50)} {copied} {prose(rnd, 20)} {' '.join(told)}"
    for k in range(90):
        # Every document has the words of item 2, in an order that is not the item's.
        words = [*reversed(stops.split()), *prose(rnd, rnd.randint(10, 150)).split()]
        if k % 2:
            words[30:30] = often.split()
            want.add((k, 1))
        if k % 9 == 0:
            words += stops.split()
            want.add((k, 2))
        docs.append((k, " ".join(words)))
    docs += [(100 + k, copy) for k in range(45)]
    want |= {(100 + k, i) for k in range(45) for i in (3, 4)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(documents(docs), benchmark).collect()} == want


def test_word_counts_leave_a_task_in_parts(spark, monkeypatch):
    """What a task sends grows with its words and comes in small batches; the weights are those of a plain count."""
    monkeypatch.setattr(decontamination, "_SENT", 16)
    rnd = random.Random(13)
    texts = [" ".join(["the", prose(rnd, rnd.randint(0, 30)), "the"]) for _ in range(60)]
    batches = pa.RecordBatch.from_pydict({"text": texts})
    sent = list(decontamination._frequencies([batches.slice(0, 30), batches.slice(30)]))
    assert len(sent) > 1 and max(b.num_rows for b in sent) <= 16
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(5)
    of = lambda word: int(decontamination._words(pa.RecordBatch.from_pydict({"text": [word]}))[0][0] >> np.uint64(64 - decontamination.DF_BITS))
    counts = defaultdict(Counter)
    for t in texts:
        words = t.split()
        for word in set(words):
            after = words[words.index(word) + 1:][:1]
            hashed = int(decontamination._words(pa.RecordBatch.from_pydict({"text": after}))[0][0]) if after else 0
            counts[of(word)][hashed % decontamination.FOLLOWERS] += 1
    frequent = {w for w, c in counts.items() if min(c[g] for g in range(decontamination.FOLLOWERS)) * decontamination.FOLLOWERS > 0.1 * 61}
    assert of("the") in frequent
    assert set(np.flatnonzero(decontamination.word_weights(docs) == 1).tolist()) == frequent


def test_every_passage_that_the_judgement_accepts(spark, documents):
    """Paraphrases that keep 50 to 60 % of the words of items of any length, the shortest among them; all that brute force accepts is found."""
    rnd = random.Random(12)
    items = [(k, " ".join(f"p{k}x{j}" for j in range(n))) for k, n in enumerate([6, 8, 10, 12, 15, 20, 40, 90, 200])]
    docs, want = [], set()
    for k in range(len(items) * 12):
        item, text = items[k % len(items)]
        text = text.split()
        n = len(text)
        # The last third stays, and of the others as many as make 50 to 60 %, or less than half.
        keep = -(-n * (50 + k % 11) // 100) if k % 4 else -(-n // 2) - 1
        rest = n - max(1, n // 3)
        stays = set(rnd.sample(range(rest), keep - (n - rest))) | set(range(rest, n))
        words = prose(rnd, 150, vocabulary=3000).split()
        at = rnd.randint(0, 150)
        words[at:at] = [w if j in stays else f"other{rnd.randint(0, 999)}" for j, w in enumerate(text)]
        docs.append((k, " ".join(words)))
        if k % 4:
            want.add((k, item))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(documents(docs), benchmark).collect()} == want


def test_quality_filter_on_held_out_rows(spark, documents):
    rnd = random.Random(4)
    docs, labels = [(None, "w1 w2"), (2000, None), (2001, "")], []
    for k in range(900):
        good = k % 3 > 0
        text = prose(rnd, rnd.randint(20, 120)) if good else " ".join(w + "$$" for w in prose(rnd, rnd.randint(20, 120)).split())
        docs.append((k, text))
        if k < 450:
            labels.append((k, int(good), 0, None))
    labels += [(3, None, None, None), (None, 1, 0, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    kept = quality_filter(documents(docs), labels)
    assert kept.columns == documents(docs).columns
    ids = {r.doc_id for r in kept.collect()}
    held_out = [k for k in range(450, 900)]
    assert sum((k in ids) == (k % 3 > 0) for k in held_out) >= 0.98 * len(held_out)
    assert resampled(documents(docs), labels.limit(0)).count() == len(docs)
    assert resampled(documents([]).limit(0), labels).count() == 0


def test_toxic_rows_go_from_long_clean_texts(spark, documents):
    rnd = random.Random(6)
    docs, labels, toxic = [], [], set()
    for k in range(900):
        words = prose(rnd, rnd.randint(20, 120) if k % 7 else 2000).split()
        if k % 3 == 0:
            words = [w + "$$" for w in words]
        elif k % 5 == 0:
            toxic.add(k)
            for _ in range(2):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["scum", "moron"]))
        docs.append((k, " ".join(words)))
        if k < 600:
            labels.append((k, int(k % 3 > 0), int(k in toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in quality_filter(documents(docs), labels).collect()}
    held_out = set(range(600, 900))
    clean = {k for k in held_out if k % 3} - toxic
    assert len(held_out & toxic) > 30 and not ids & held_out & toxic
    assert len(ids & clean) >= 0.98 * len(clean)


def test_gumbel_top_k(spark):
    rows = spark.range(2000).select(F.col("id").alias("key"), F.log(1.0 + F.col("id") % 4).alias("log_weight"))
    kept = gumbel_top_k(rows, 300)
    assert kept.count() == 300
    best = {r.key for r in gumbel_top_k(rows, 2000).orderBy(F.desc("key_value")).limit(300).collect()}
    assert {r.key for r in kept.collect()} == best
    share = Counter(r.key % 4 for r in kept.collect())
    assert share[0] < share[1] < share[3]  # weights 1, 2, 3, 4
    ties = rows.select(F.lit(7).alias("key"), F.lit(0.0).alias("log_weight"))
    assert gumbel_top_k(ties, 5).count() == 2000


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hö"), (1, 3, "ann", None), (1, 3, "ann", None),
             (2, None, None, "alone"), (None, 0, "ann", "x"), (3, 0, "system", "only")]
    turns += [(4, k, "ab"[k % 2], "t" * (k % 7)) for k in range(700)]
    table = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, speaker string").drop("speaker")
    views = rotated(table, block=64)
    whole = {(r.conv_id, r.speaker): r for r in rendered(views).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann"), (4, "a"), (4, "b")}
    assert whole[1, "bob"].dialogue == "<|system|>\nbe kind\n<|user:ann|>\nhi\n<|assistant|>\nhö\n<|user:ann|>\n\n<|user:ann|>\n\n"
    for r in whole.values():
        own = [r.dialogue[s.start:s.end] for s in r.spans]
        said = [(t or "") for c, k, role, t in turns if c == r.conv_id and (role or "unknown") == r.speaker]
        assert own == said
    assert views.where("conv_id = 4 and speaker = 'a'").agg(F.max("position")).first()[0] == 699
    assert rotated(table.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settled(stage(spark, docs, sf_dir), "test-pipeline")
        assert out.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in out.collect()}
        assert ids <= seen
        docs, seen = out, ids
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in encoded.select("doc_id").collect()} == seen
