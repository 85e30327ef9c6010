"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

An item leaks into a document if a window of as many words as the item has (fewer at the
document's end) is within floor(words / 5) word edits of it: similarity 0.8 or more. Words
are compared in lower case and without ASCII punctuation. Items of fewer than five words
have no edit to spare: they leak where they stand word for word.

Every window of every document takes CGK random walks, which read a word and move on or
stay by a random bit of it; so edit distance becomes Hamming distance between walks. Items
are sorted into size classes, a factor of two apart; a window's walk as long as the class
needs is sampled at PLACES steps, REPEATS times for each of WALKS walks, and windows that
agree with an item in one sample are candidates (an item longer than its class gives its
last words as a window too, one longer than the largest class all its stretches). Windows
as far as the allowed edits beside a candidate are verified with it by exact edit distance.
The recall of that search against all windows is tested: 0.9 or more, in fact nearly 1.

Items go out in blocks of bounded size, each against all documents.

Results in special cases: null and empty texts match nothing, and items without words
nowhere; repeated rows each give their hits; of windows equally near to an item the first
is given; items that repeat an item_id count each by itself, the nearest being given; very
long texts and items are read whole, in pieces of one text at least; empty tables give an
empty one; items without an item_id are left out; columns other than doc_id, item_id and
text are not read, or passed on by without_leaks().
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import LOWER, buffers, mix, prefix_hashes, span_hashes, text_of, unused, word_spans

EDITS_PER = 5
#: Walks of a window, samples of a walk, sampled steps in one, and bytes of items in one block.
WALKS, REPEATS, PLACES, BLOCK_BYTES = 2, 7, 3, 4 << 20
#: Least words of the size classes; a walk takes 3 steps for 2 words.
CLASSES = (1, 2, 3, 4, 8, 16, 32)
#: Bytes of text that walk at once, and starts at most to either side of a candidate that are verified.
PIECE, BESIDE = 1 << 16, 16
#: Leading bits of a sample that a first look tells from those of items.
MARKS = 20
HITS = "array<struct<item_id:bigint,start_word:bigint,distance:bigint,words:bigint>>"

# punctuation is deleted, white space and the rest stay
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word in normal form; words of punctuation alone vanish."""
    keep = ~PUNCTUATION[data]
    place = np.concatenate(([0], np.cumsum(keep)))
    data, offsets = LOWER[data[keep]], place[offsets]
    start, end, row = word_spans(data, offsets)
    return span_hashes(prefix_hashes(data), start, end), row


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return normal_words(data, np.array([0, len(data)]))[0]


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Word edits between a and b by bit-parallel columns; most + 1 if above most."""
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    mask: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        mask[x] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = mask.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus = down | ~(xv | up) & full
        minus = up & xv
    return min(score, most + 1)


def walks(words: np.ndarray, steps: int, walk: int) -> Iterator[np.ndarray]:
    """Where the CGK walk from every start is, step by step; len(words) past the end."""
    at = np.arange(len(words))
    for i in range(steps):
        if i % 64 == 0:  # a word's random bits; past the end there are none
            bits = np.append(mix(words + np.uint64((walk << 32 | i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), np.uint64(0))
            planes = np.ascontiguousarray(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1)[:, : min(64, steps - i)].T)
        yield at
        at = at + planes[i % 64].take(at)


def steps_of(size: int) -> int:
    return max(1, 3 * size // 2)


@functools.cache
def samples(size: int, walk: int) -> list[list[int]]:
    """The steps that each repetition samples of a walk over windows of a class: one in each of PLACES equal parts."""
    rng = np.random.default_rng([20, size, walk])
    steps = steps_of(size)
    edges = [steps * k // PLACES for k in range(PLACES + 1)]
    return [sorted({int(rng.integers(a, max(a + 1, b))) for a, b in zip(edges, edges[1:], strict=False)}) for _ in range(REPEATS)]


def sampled(words: np.ndarray, sizes: list[int], apart: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, repetition, sampled walk as a number) for the windows from every start.

    apart: leave samples out that read one word twice from the first start, if the class has words enough.
    """
    padded = np.append(words, np.uint64(0))
    for walk in range(WALKS):
        wanted = {i for size in sizes for places in samples(size, walk) for i in places}
        where = list(walks(words, max(wanted) + 1, walk))
        seen = [padded.take(at) if i in wanted else None for i, at in enumerate(where)]
        for size in sizes:
            for k, places in enumerate(samples(size, walk)):
                if apart and size > 2 * PLACES and len({int(where[i][0]) for i in places}) < PLACES:
                    continue
                out = seen[places[0]] * np.uint64(((walk * REPEATS + k) * 64 + size) * 2 + 1)
                for j, i in enumerate(places[1:], 1):
                    out += seen[i] * np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                yield size, walk * REPEATS + k, out


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], least: int = 1) -> None:
        self.items = [(i, w) for i, w in ((i, words_of(t or "")) for i, t in items) if len(w) >= least]
        self.lists = [w.tolist() for _, w in self.items]
        self.sets = [set(w) for w in self.lists]
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            size = max(c for c in CLASSES if c <= len(w))
            for offset in sorted({*range(0, len(w) - size + 1, size), len(w) - size}):
                for c, _, values in sampled(w[offset : offset + size], [size], True):
                    found[c].append((int(values[0]), k, offset))
        # of a class: the samples in order, and the item and offset of each
        self.known = {}
        for c, rows in found.items():
            rows = sorted(set(rows))
            self.known[c] = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.marks = {}
        for c, (values, _, _) in self.known.items():
            self.marks[c] = np.zeros(1 << MARKS, dtype=bool)
            self.marks[c][(values >> np.uint64(64 - MARKS)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of windows that agree with an item in a sample, once each; a start may lie before the words."""
        items, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, _, values in sampled(words, sorted(self.known)) if self.known and len(words) else ():
            known, item, offset = self.known[c]
            at = np.flatnonzero(self.marks[c].take((values >> np.uint64(64 - MARKS)).view(np.int64)))
            lo, hi = (np.searchsorted(known, values[at], side=side) for side in ("left", "right"))
            n = hi - lo
            of = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)))[:-1], n)
            items.append(item[of])
            starts.append(np.repeat(at, n) - offset[of])
        both = np.unique(np.stack((np.concatenate(items), np.concatenate(starts))), axis=1)
        return both[0], both[1]

    def hits(self, words: np.ndarray, rows: np.ndarray, count: int) -> dict[int, list[tuple[int, int, int, int]]]:
        """Per row: (item, first word, distance, words of the item), the best window of each item."""
        begin = np.searchsorted(rows, np.arange(count + 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: set[tuple[int, int]] = set()
        for k, p in zip(*(x.tolist() for x in self.candidates(words)), strict=True):
            own, size, known = self.lists[k], len(self.lists[k]), self.sets[k]
            edits = size // EDITS_PER
            row = int(rows[min(max(p, 0) + size // 2, len(rows) - 1)]) if size > 1 else int(rows[p])
            # the window may have begun in the row before, or end in the one after
            for r in {row, int(rows[max(p, 0)]), int(rows[min(p + size - 1, len(rows) - 1)])}:
                lo, hi = int(begin[r]), int(begin[r + 1])

                def distance(q: int, most: int) -> int:
                    window = words[q : min(q + size, hi)].tolist()  # noqa: B023
                    # each word of the item that the window lacks is an edit at least
                    return most + 1 if size - sum(map(known.__contains__, window)) > most else edit_distance(own, window, most)  # noqa: B023

                # a window that begins s words beside another is at most 2 s edits nearer
                q = min(max(p, lo), hi - 1)
                if (k, q) in done or distance(q, 3 * edits) > 3 * edits:
                    continue
                step = max(1, edits // BESIDE)
                for s in range(max(lo, q - edits), min(hi - 1, q + edits) + 1, step):
                    if (k, s) not in done:
                        done.add((k, s))
                        d = distance(s, edits)
                        if d <= edits:
                            best[r, k] = min(best.get((r, k), (d, s - lo)), (d, s - lo))
                done.add((k, q))
        out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        of: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (r, k), (d, p) in best.items():
            key, new = (r, self.items[k][0]), (d, p, len(self.items[k][1]))
            of[key] = min(of.get(key, new), new)
        for (r, i), (d, p, n) in sorted(of.items()):
            out[r].append((i, p, d, n))
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, about BLOCK_BYTES of text at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where(F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 64)).collect()[0][0] or 0
    count = -(-total // BLOCK_BYTES)
    for b in range(count):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()]


def with_hits(df: DataFrame, items: list[tuple[int, str]], name: str = "hits", least: int = 1) -> DataFrame:
    """df with a last column of the hits of the items in its texts."""
    hit = StructType().add("item_id", LongType()).add("start_word", LongType()).add("distance", LongType()).add("words", LongType())
    schema = StructType([*df.schema.fields]).add(name, ArrayType(hit))
    column = df.columns.index("text")
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in hit.fields]))
    shared = df.sparkSession.sparkContext.broadcast(items)  # a block: BLOCK_BYTES or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(shared.value, least)
        for batch in batches:
            found: list = []
            for lo, hi, data, offsets in buffers(batch.column(column), PIECE):
                words, rows = normal_words(data, offsets)
                got = block.hits(words, rows, hi - lo)
                found += [[dict(zip(hit.names, x, strict=True)) for x in got.get(k, ())] for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def benchmark_leaks(documents: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """One row per document and item of at least so many words that leaks into it, with its best window."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for items in blocks(benchmark):
        found = with_hits(texts, items, least=least).select("doc_id", F.explode("hits").alias("h"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.limit(0).select("doc_id", F.explode(F.array().cast(HITS)).alias("h"))
    similarity = 1 - F.col("h.distance") / F.col("h.words")
    return out.select("doc_id", "h.item_id", "h.start_word", "h.distance", similarity.alias("similarity"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: int = 5) -> DataFrame:
    """The documents into which no item of at least so many words leaks, with all their columns."""
    kept, name = documents, unused(documents, "leaked")
    for items in blocks(benchmark):
        kept = with_hits(kept, items, name, least).where(F.size(F.col(name)) == 0).drop(name)
    return kept
