"""Arrow batches in pieces of bounded size, so that what a task makes of a piece stays small however long its texts are."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; a longer text stands alone.
PIECE = 2 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, as many at a time as hold `most` bytes in a column of texts, one at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, since the worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not every C library has it
