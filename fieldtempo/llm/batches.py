"""What keeps a Python worker small: batches in parts, and unused memory given back.

A worker runs the tasks of one stage after the other beside its executor, so what it once held and does
not give back counts in all that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a part has, where nothing else is asked for.
PART = 1_000_000

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def parts(batch: pa.RecordBatch, text: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most so many bytes of a column, or of one row."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for n, length in enumerate(lengths):
        if n > start and size + length > most:
            yield batch.slice(start, n - start)
            start, size = n, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)


def releasing(run: Task) -> Task:
    """The same work; once a task ends, Arrow's pool gives back what it kept for further batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task
