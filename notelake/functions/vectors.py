"""Cosine similarity as a column expression, and Arrow helpers for the block kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; NULL when the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity in double; 0.0 when either vector has no length."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).otherwise(
        F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)
    )


class VectorColumn:
    """Rows of an Arrow list<float> column, addressable as dense blocks."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = array.value_lengths().fill_null(-1)
        self.dims = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
        self._values = array.flatten().to_numpy(zero_copy_only=False)
        self._starts = np.cumsum(np.maximum(self.dims, 0)) - np.maximum(self.dims, 0)

    def block(self, rows: np.ndarray) -> "Block":
        """The given rows, which must share one dimension."""
        dim = int(self.dims[rows[0]]) if len(rows) else 0
        return Block(self._values[self._starts[rows][:, None] + np.arange(dim)[None, :]])


class Block:
    """Vectors of one tile as stored, their exact norms, and unit copies for the fast filter.

    Only rows that pass the filter are ever widened to double.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.norms = np.sqrt(np.einsum("ij,ij->i", values, values, dtype=np.float64))
        safe = np.where(self.norms == 0.0, 1.0, self.norms)
        self.unit = (values / safe[:, None]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.norms)

    @property
    def slack(self) -> float:
        """Bound on the float32 rounding of a unit inner product, kept on the generous side."""
        return 1e-6 + 2.4e-7 * self.values.shape[1]


def exact_cosine(a: Block, rows_a: np.ndarray, b: Block, rows_b: np.ndarray) -> np.ndarray:
    scale = a.norms[rows_a] * b.norms[rows_b]
    dots = np.einsum("ij,ij->i", a.values[rows_a].astype(np.float64), b.values[rows_b].astype(np.float64))
    return np.where(scale == 0.0, 0.0, dots / np.where(scale == 0.0, 1.0, scale))


def passes(sims: np.ndarray, threshold: float, strict: bool) -> np.ndarray:
    return sims > threshold if strict else sims >= threshold


def subgroups(table: pa.Table, names: list[str], *numbers: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each distinct key combination, exact on the key values themselves."""
    codes = np.zeros(table.num_rows, np.int64)
    for name in names:
        part = table.column(name).combine_chunks().dictionary_encode()
        index = part.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * len(part.dictionary) + index, return_inverse=True)[1]
    for column in numbers:
        values, index = np.unique(column, return_inverse=True)
        if len(values) > 1:
            codes = np.unique(codes * len(values) + index, return_inverse=True)[1]
    if len(codes):
        order = np.argsort(codes, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)
