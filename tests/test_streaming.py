import json
import math
import os

from pyspark.sql import functions as F

from notelake import session
from notelake.catalog import QUERIES
from notelake.sources import snapshots
from notelake.streaming import admit
from notelake.streaming.admit import admit_into, read_admitted, stream_admit, stream_admit_semantic

DDL = "id bigint, role string, category string, text string, embedding array<float>"


def _stream(spark, folder):
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(str(folder))


def test_exact_text_once_for_ever(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"id": 1, "role": "r", "category": "c", "text": "Hi"}\n{"id": 2, "role": "r", "category": "c", "text": " "}')
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream_admit(_stream(spark, source), sink, state).awaitTermination()
    (source / "2.json").write_text('{"id": 3, "role": "r", "category": "c", "text": " hi\\n"}\n{"id": 4, "role": "r", "category": "d", "text": "hi"}')
    stream_admit(_stream(spark, source), sink, state).awaitTermination()
    assert {r["id"] for r in spark.read.parquet(sink).collect()} == {1, 4}


def test_vectors_against_earlier_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    batches = ['{"id": 1, "role": "r", "category": "c", "text": "a", "embedding": [1.0, 0.0]}',
               '{"id": 2, "role": "r", "category": "c", "text": "b", "embedding": [1.0, 0.1]}\n'
               '{"id": 3, "role": "r", "category": "c", "text": "c", "embedding": [0.0, 1.0]}']
    for n, text in enumerate(batches):
        (source / f"{n}.json").write_text(text)
        stream_admit_semantic(_stream(spark, source), sink, state).awaitTermination()
    assert {r["id"] for r in spark.read.schema(DDL).parquet(sink).collect()} == {1, 3}


def _feed(spark, source, sink, state, numbers, text):
    for n in numbers:
        (source / f"{n}.json").write_text(text(n))
    stream_admit_semantic(_stream(spark, source), sink, state).awaitTermination()


def _row(i, vector, category="c"):
    return json.dumps({"id": i, "role": "r", "category": category, "text": f"t{i}", "embedding": vector})


def test_a_new_checkpoint_over_an_old_sink_loses_nothing(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    _feed(spark, source, sink, str(tmp_path / "state"), [0], lambda n: _row(1, [1.0, 0.0]))
    again = tmp_path / "in2"
    again.mkdir()
    _feed(spark, again, sink, str(tmp_path / "state2"), [0, 1], lambda n: _row(2, [1.0, 0.01]) if n else _row(3, [0.0, 1.0]))
    schema = spark.createDataFrame([], DDL).schema
    assert {r["id"] for r in read_admitted(spark, sink, schema).collect()} == {1, 3}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], DDL).schema
    sink = str(tmp_path / "out")
    step = admit_into(sink, schema)
    batch = spark.createDataFrame([(1, "r", "c", "a", [1.0, 0.0]), (2, "r", "d", "b", None)], schema)
    step(batch, 0)
    step(batch.withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")), 0)
    assert {r["id"] for r in read_admitted(spark, sink, schema).collect()} == {1, 2}
    assert {r["id"] for r in read_admitted(spark, sink, schema, [("r", "d")]).collect()} == {2}


def test_many_batches_keep_folders_few_and_scratch_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(admit, "MERGED", 3)
    schema = spark.createDataFrame([], DDL).schema
    sink, scratch = str(tmp_path / "out"), []
    monkeypatch.setattr(admit, "materialize", lambda df, label: scratch.append(session.scratch_path(spark, label)) or session.materialize(df, label))
    step = admit_into(sink, schema)
    for n in range(10):
        turn = math.radians(3 * n)
        rows = [(10 * n + 1, "r", "c", f"t{n}", [math.cos(turn), math.sin(turn)]), (10 * n + 2, "r", "d", "same text", None)]
        step(spark.createDataFrame(rows, schema), n)
    # At 3 degrees a step and a threshold of 0.92 (some 23 degrees), every eighth vector is new.
    got = {r["id"] for r in read_admitted(spark, sink, schema).collect()}
    assert got == {1, 2, 81}
    for n in range(10, 24):
        step(spark.createDataFrame([(10 * n + 1, "r", "c", f"t{n}", [0.0] * n + [1.0])], schema), n)
    now = snapshots.current(spark, sink)
    assert read_admitted(spark, sink, schema).count() == 3 + 14
    assert len(now.folders) <= 8 and dict(now.batches) == {"only": 23}
    assert not any(os.path.exists(p.rsplit("/", 1)[0]) for p in scratch)


def test_streamed_tables_may_be_folders_and_may_admit_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hi", "en"), (2, " hi\n", "en"), (3, "hi", "de"), (4, None, "de")], "doc_id bigint, text string, lang string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(n, [float(n == k) for k in range(20)], 0) for n in range(17, 20)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {(r["category"], r["normalized"]) for r in QUERIES["stream_admit"](spark, str(tmp_path)).collect()} == {("en", "hi"), ("de", "hi")}
    assert {r["id"] for r in QUERIES["stream_admit_semantic"](spark, str(tmp_path)).collect()} == {85, 90, 95}
    docs.where("text is null").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["stream_admit"](spark, str(tmp_path / "none")).count() == 0
