"""Units that repeat in a row, by comparing a text with itself some places on, in time that grows with the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

#: Characters of a unit, and how often it stands in a row at least (functions/text.py has the same as a pattern, FILLER_REPEAT).
SHORTEST, LONGEST, TIMES = 10, 30, 4
#: Every STEP-th place is looked at first: as many places in a row as the shortest repetition has must agree.
STEP = 5
SEEN = SHORTEST * (TIMES - 1) // STEP
BREAKS = (0x0A, 0x0D, 0x2028, 0x2029)


def likely_units(codes: np.ndarray) -> list[int]:
    """The lengths, longest first, of units that may repeat in a text of code points; none that does is left out."""
    every = [np.ascontiguousarray(codes[k::STEP]) for k in range(STEP)]
    found = []
    for u in range(min(LONGEST, len(codes) // TIMES), SHORTEST - 1, -1):
        later = every[u % STEP][u // STEP :]
        same = every[0][: len(later)] == later
        span = 1
        while span < SEEN and len(same):
            k = min(span, SEEN - span)
            same, span = same[:-k] & same[k:], span + k
        if same.any():
            found.append(u)
    return found


def count_repeats(text: str) -> int:
    """Leftmost non-overlapping runs of a unit of SHORTEST to LONGEST characters, TIMES or more in a row on one line; of several units at a place the longest, as often as it stands there."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    units = likely_units(codes)
    if not units:
        return 0
    # a line's end is like no other character
    ends = np.isin(codes, BREAKS)
    codes = np.where(ends, np.cumsum(ends, dtype=np.uint32) + np.uint32(0x110000), codes)
    runs = {}
    for u in units:
        edges = np.flatnonzero(np.diff((codes[:-u] == codes[u:]).astype(np.int8), prepend=0, append=0))
        start, end = edges[::2], edges[1::2]
        long = end - start >= u * (TIMES - 1)
        if long.any():
            runs[u] = list(zip(start[long].tolist(), end[long].tolist(), strict=True))[::-1]
    count = at = 0
    while True:
        best = None
        for u, left in runs.items():
            while left and left[-1][1] - u * (TIMES - 1) < at:
                left.pop()
            if left and (best is None or max(left[-1][0], at) < best[0]):
                best = max(left[-1][0], at), u, left[-1][1]
        if best is None:
            return count
        begin, u, end = best
        count, at = count + 1, begin + u * ((end - begin) // u + 1)


@arrow_udf(LongType())
def _repeats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([count_repeats(x.as_py() or "") for x in texts], pa.int64())


def repeats(text: Column) -> Column:
    """How many units repeat in a text; none in null."""
    return _repeats(text)
