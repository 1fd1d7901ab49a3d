"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

#: Texts handled at once inside a batch, in bytes (one longer text is handled alone).
PIECE_BYTES = 4 << 20


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """An object made once per Python worker and kept between its tasks.

    Only for what can be made again at any time: tokenizers, word caches, tables.
    """
    holder = sys.modules.setdefault("_termlens_worker_state", types.ModuleType("_termlens_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the binary or text ``column`` of a piece holds about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for row, length in enumerate(lengths):
            if held and held + length > most:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += length
        yield batch.slice(begin)


def binary_column(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values, with empty bytes for null."""
    return [value or b"" for value in batch.column(column).to_pylist()]
