"""Token ids as flat files.

A folder holds, for each part p of a range partitioning by doc_id:

    ids-p.bin       the ids of all documents, unsigned little-endian integers of 16 bits, or 32 if the vocabulary needs it
    offsets-p.bin   unsigned 64-bit: first id of each document within the part, and the end
    doc_ids-p.bin   signed 64-bit doc_id of each document (the largest value: none)

and ``manifest``, a small Parquet table with a row per part: part, n_docs, n_tokens, width, and
first_doc and first_token, the prefix sums over the parts before. Parts follow each other in doc_id
order. A task writes under a name of its own and renames at its end, so repeated and speculative
attempts leave one whole file.

Defined results: null text counts as empty, its ids are the end id alone; rows without doc_id come
last; rows of equal doc_id follow each other by a hash of the text; other columns are ignored; an
empty table gives no documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .chunks import encoder, token_bounds
from .scratch import given_id, keyed

_PART = "part int, n_docs long, n_tokens long, width int"


def _located(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as tasks need it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    full = folder.getFileSystem(conf).makeQualified(folder).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _written(root: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _located(root)
        encode = encoder(tokenizer)
        kind = np.dtype("<u2") if max(encode.vocabulary - 1, end_id) < 1 << 16 else np.dtype("<u4")
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        draft = {n: f"{folder}/_{n}-{part:06d}-{attempt}" for n in ("ids", "offsets", "doc_ids")}
        docs = tokens = 0
        out = None
        for piece in (p for b in batches for p in K.slices(b, "text")):
            if out is None:
                out = {n: fs.open_output_stream(p) for n, p in draft.items()}
                out["offsets"].write(np.zeros(1, "<u8").tobytes())
            raw, offsets = K.utf8(piece.column("text"))
            ids, sizes, starts = encode.encode(raw, offsets)
            bounds = token_bounds(sizes, starts, offsets)
            n = len(piece)
            whole = np.full(len(ids) + n, end_id, kind)
            whole[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            out["ids"].write(whole.tobytes())
            out["offsets"].write((tokens + bounds[1:] + np.arange(1, n + 1)).astype("<u8").tobytes())
            out["doc_ids"].write(piece.column("id").to_numpy().astype("<i8").tobytes())
            docs += n
            tokens += len(whole)
        if out is not None:
            for name, stream in out.items():
                stream.close()
                fs.move(draft[name], f"{folder}/{name}-{part:06d}.bin")
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "n_docs": [docs], "n_tokens": [tokens], "width": pa.array([kind.itemsize], pa.int32())})

    return run


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every document and write the folder ``root``. ``tokenizer``: file of the tokenizers library, readable by all executors."""
    spark = docs.sparkSession
    root = qualified(spark, root)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(fs)
    ordered = keyed(docs).repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    parts = ordered.select("id", "text").mapInArrow(_written(root, tokenizer, end_id), _PART)
    parts.write.parquet(f"{root}/parts")
    # One row per part: the prefix sums give every part its place.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(_PART).parquet(f"{root}/parts").select(
        "*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"first_{n[2:-1]}") for n in ("n_docs", "n_tokens")])
    manifest.write.parquet(f"{root}/manifest")


def _mapped(fs: pyarrow.fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A local file memory-mapped, any other read."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.readall(), kind)


def _read(root: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _located(root)
        for batch in batches:
            for part in batch.to_pylist():
                name = f"{part['part']:06d}.bin"
                ids = _mapped(fs, f"{folder}/ids-{name}", f"<u{part['width']}")
                offsets = _mapped(fs, f"{folder}/offsets-{name}", "<u8").astype(np.int64)
                doc_ids = _mapped(fs, f"{folder}/doc_ids-{name}", "<i8")
                for low in range(0, len(doc_ids), 256):
                    high = min(low + 256, len(doc_ids))
                    each = [np.asarray(ids[a:b]).astype("<u4").tobytes() for a, b in zip(offsets[low:high], offsets[low + 1:high + 1])]
                    last = {"ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())} if digest else {"ids": pa.array(each, pa.binary())}
                    yield pa.record_batch({"id": np.asarray(doc_ids[low:high]), "start": offsets[low:high] + part["first_token"], "n_tokens": np.diff(offsets[low:high + 1]), **last})

    return run


def read_token_files(spark: SparkSession, root: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary: little-endian unsigned 32-bit), or ids_crc32 in place of ids."""
    root = qualified(spark, root)
    manifest = spark.read.parquet(f"{root}/manifest").select("part", "width", "first_token")
    last = "ids_crc32 long" if digest else "ids binary"
    rows = manifest.repartition("part").mapInArrow(_read(root, digest), f"id long, start long, n_tokens long, {last}")
    return rows.select(given_id(), "start", "n_tokens", last.split()[0])
