"""Rows that a task makes, in Arrow batches of bounded size. Without pandas, which would cost each Python worker its memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS, BYTES = 1024, 1 << 24


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch ROWS rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def frames(batches: Iterator) -> Iterator:
    """The same of data frames."""
    for b in batches:
        for i in range(0, len(b), ROWS):
            yield b.iloc[i : i + ROWS]


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most ROWS, of about BYTES in files and lists."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes | list))
        if len(held) >= ROWS or size >= BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()
