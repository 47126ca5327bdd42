"""What the vector operators share: usable rows, integer blocks, halved bounds and packed arrays.

Usable vectors have the asked length and no null or non-finite component. Blocks
are bounded by rows, so a task holds one block at a time whatever its partition's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components lie below this in size: squared distances of 64 of them, doubled coordinates included, fit 63 bits.
COMPONENT_LIMIT = 1 << 26


def finite(vector: Column) -> Column:
    """True where a vector is there and holds only finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def common_length(vectors: DataFrame, vector_col: str, parts: int = 1) -> int:
    """The most frequent length that ``parts`` divides, the longer of equally frequent ones; 0 if there is none."""
    lengths = vectors.where(finite(F.col(vector_col)) & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0)).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def rows_of(column: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and them as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims)
    flat = column.take(pa.array(right)).flatten()
    matrix = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(len(right), dims)
    sound = np.isfinite(matrix).all(axis=1)
    return right[sound], matrix[sound]


def int_blocks(batches: Iterator[pa.RecordBatch], vector_col: str, dims: int, scale: int, size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of up to ``size`` rows: the other columns, and ``floor(scale * x)`` of every component."""
    carried, matrices, held = [], [], 0

    def block() -> tuple[pa.Table, np.ndarray]:
        return pa.concat_tables(carried).combine_chunks(), np.concatenate(matrices)

    for batch in batches:
        at = batch.schema.get_field_index(vector_col)
        names = [n for n in batch.schema.names if n != vector_col]
        keep, values = rows_of(batch.column(at), dims)
        scaled = np.floor(values * scale)
        if len(scaled) and np.abs(scaled).max() >= COMPONENT_LIMIT:
            raise ValueError(f"a component times {scale} is not below {COMPONENT_LIMIT} in size")
        carry = pa.Table.from_batches([batch.select(names)]).take(pa.array(keep))
        ints, done = scaled.astype(np.int64), 0
        while done < len(ints):
            n = min(size - held, len(ints) - done)
            carried.append(carry.slice(done, n))
            matrices.append(ints[done : done + n])
            done, held = done + n, held + n
            if held == size:
                yield block()
                carried, matrices, held = [], [], 0
    if held:
        yield block()


def halved(n: int, leaf: int) -> list[np.ndarray]:
    """Bounds of a binary tree over ``n`` places, level by level, until no node holds over ``leaf`` (2 at least)."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        b = levels[-1]
        finer = np.empty(2 * len(b) - 1, dtype=np.int64)
        finer[0::2], finer[1::2] = b, (b[:-1] + b[1:]) // 2
        levels.append(finer)
    return levels


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given spans, one span after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def pack(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, dtype=kind).tobytes()


def unpack(data: bytes, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(shape)


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def joined_digits(entries: np.ndarray) -> str:
    """Integers in decimal, in order, joined by commas."""
    return ",".join(str(int(x)) for x in entries.ravel())
