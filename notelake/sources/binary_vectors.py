"""Vectors stored as packed little-endian float32 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _floats(blobs: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Arrow arrays (vector, is_broken) without touching single values."""
    sizes = pc.binary_length(blobs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    broken = sizes % 4 != 0
    good = ~broken & blobs.is_valid().to_numpy(zero_copy_only=False)
    kept = blobs.filter(pa.array(good))
    values = np.frombuffer(b"".join(kept.to_pylist()), "<f4")
    offsets = np.concatenate([[0], np.cumsum(np.where(good, sizes // 4, 0))]).astype(np.int32)
    vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float32()), mask=pa.array(~good))
    return vectors, pa.array(broken)


def _blobs(vectors: pa.Array) -> pa.Array:
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    packed = pa.Array.from_buffers(
        pa.binary(), len(vectors), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    )
    return pc.if_else(vectors.is_valid(), packed, pa.scalar(None, pa.binary()))


def decode_embeddings(df: DataFrame, column: str = "embedding", broken: str = "broken") -> DataFrame:
    """Binary column to float vectors. A length that is no multiple of four gives NULL and ``broken``."""
    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.FloatType()) if f.name == column else f.dataType) for f in df.schema]
        + [T.StructField(broken, T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, bad = _floats(batch.column(column))
            columns = [vectors if n == column else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, bad], [*batch.schema.names, broken])

    return df.mapInArrow(run, schema)


def encode_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Float vectors to the packed form."""
    schema = T.StructType(
        [T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in df.schema]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_blobs(batch.column(n)) if n == column else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)
