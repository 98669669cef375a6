"""Rows in and out of Arrow batches, a bounded part at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa

#: Characters, and rows, that one batch of results holds before it is handed on; a larger row is a batch of its own.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 1 << 12


def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as tuples, taken out of it by slices of about ``BATCH_CHARS``."""
    step = max(1, batch.num_rows * BATCH_CHARS // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield from zip(*[column.to_pylist() for column in batch.slice(at, step).columns])


def batched(found: Iterable[Sequence], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows put together to batches: short ones travel together, and no batch holds many long ones."""
    held: list[Sequence] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)

    for row in found:
        held.append(row)
        size += sum(len(value) for value in row if isinstance(value, (str, bytes)))
        if size >= BATCH_CHARS or len(held) >= BATCH_ROWS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()
