"""The pipeline's stages on planted documents, each against brute force or what was planted, on its own input."""

import random

import pytest
from test_dedup import brute_components

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from notelake.session import scratch_path  # noqa: E402

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, `row` int"


def _prose(rnd, n):
    return [f"w{rnd.randint(0, 2500)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(21)
    item = [f"q{k}" for k in range(30)]
    passage = _prose(rnd, 30)
    docs, labels, junk, toxic, leaking = [], [], set(), set(), set()
    for k in range(420):
        words = _prose(rnd, rnd.randint(40, 110))
        if k % 4 == 0:
            junk.add(k)
            words = [w + "$$" for w in words]
        elif k % 9 == 1:
            toxic.add(k)
            words[5:5] = ["scum", "moron", "scum"]
        elif k in (401, 405, 409, 413):
            leaking.add(k)
            words[20:20] = item
        elif k in (303, 307, 311, 315, 319):
            words[10:10] = passage
        docs.append((k, " ".join(words)))
        if k < 300:
            labels.append((k, int(k % 4 > 0), int(k in toxic)))
    base = docs[389][1].split()
    for k in range(6):
        copy = list(base)
        copy[rnd.randrange(len(copy))] = "changed"
        docs.append((500 + k, " ".join(copy)))
    docs += [(600, docs[391][1]), (601, None), (602, ""), docs[393], (None, "w1 w2 w3")]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in docs]
    sf_dir = scratch_path(spark, "planted")
    spark.createDataFrame(rows, DDL).repartition(4).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return sf_dir, junk, toxic, leaking


def _without_repeats(rows, length=100):
    """Texts without the bytes of strings that also start earlier, by doc_id, then by place."""
    seen, out = {}, {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts, key=lambda i: (i is None, i)):
        for a in range(len(texts[i]) - length + 1):
            seen.setdefault(texts[i][a:a + length], (i, a))
    for i, raw in texts.items():
        gone = set()
        for a in range(len(raw) - length + 1):
            if seen[raw[a:a + length]] != (i, a):
                gone.update(range(a, a + length))
        out[i] = bytes(c for p, c in enumerate(raw) if p not in gone).decode()
    return out


def test_each_stage(spark, planted):
    sf_dir, junk, toxic, leaking = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settled(stage(spark, docs, sf_dir), "test-pipeline")
        assert out.dtypes == docs.dtypes, name
        now = [(r.doc_id, r.text) for r in out.collect()]
        ids, were = {i for i, _ in now}, {i for i, _ in before}
        if name == "quality":
            unseen = {i for i in were if i is not None and 300 <= i < 420}
            clean = unseen - junk - toxic
            assert len(ids & clean) >= 0.97 * len(clean) and len(ids & unseen & junk) <= 1 and not ids & unseen & toxic
        elif name == "near_duplicates":
            groups = {}
            for (i, _), (_, size, least) in zip(before, brute_components(before)):
                groups.setdefault(least if size else ("no words", i), []).append(i)
            assert ids == {min(g, key=lambda i: (i is None, i)) for g in groups.values()}
            assert len(now) == sum(1 for _ in groups)
        elif name == "repeated_text":
            # A missing text stays missing.
            assert {i: t or "" for i, t in now} == _without_repeats(before)
            assert {i for i, t in now if t is None} == {i for i, t in before if t is None}
            assert sum(len(t or "") for _, t in now) < sum(len(t or "") for _, t in before)
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
        elif name == "decontamination":
            # The stage before has cut the passage from all but the first of its documents.
            holding = {i for i, t in before if t and " ".join(f"q{k}" for k in range(30)) in t}
            assert were - ids == holding and holding and holding < leaking
        kept[name], before, docs = ids, now, out
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in encoded} == kept["decontamination"]
    assert max(r["rank"] for r in encoded) == 2


def test_no_documents(spark, planted):
    sf_dir, *_ = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
