"""Arrow batches in small parts, so that a task's memory does not grow with the length of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts, and texts, that a task turns into Python's own at a time.
BYTES, ROWS = 1 << 20, 512


def parts(texts: pa.Array, most: int = BYTES, rows: int = ROWS) -> Iterator[pa.Array]:
    """Neighbouring texts of `most` bytes and `rows` at most together; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        begun = ends[low - 1] if low else 0
        high = min(max(low + 1, int(np.searchsorted(ends, begun + most, "right"))), low + rows)
        yield texts.slice(low, high - low)
        low = high


def slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of a batch as parts() deals out its texts."""
    low = 0
    for few in parts(texts):
        yield batch.slice(low, len(few))
        low += len(few)


def release() -> None:
    """Give back what Arrow holds and does not use; a worker keeps it otherwise, for the tasks of later stages too."""
    pa.default_memory_pool().release_unused()


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back unused memory after each batch and at its end."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            release()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(given(batches))
        release()

    return whole


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    flat = pa.array(np.ascontiguousarray(matrix).reshape(-1)).cast(kind.value_type)
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] if matrix.ndim == 2 else 0))
    return pa.ListArray.from_arrays(offsets, flat).cast(kind)
