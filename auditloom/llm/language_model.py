"""Language-model scoring with a log-frequency Bloom filter.

A first pass sends every group of rows' distinct tokens and bigrams, with their counts in
training documents, to buckets. A bucket adds the counts up and builds its segment of the
filter: an n-gram that occurs c times is inserted once for each level 1 to 1 + floor(log2 c).
A segment has BITS_PER_GRAM bits for each of its n-grams, whatever the corpus; it stays in
its bucket, and each group's n-grams are probed there. A probe goes up an n-gram's levels
until one is missing, which gives its quantised count (never too low; too high where other
n-grams' bits collide). The answers go back to the groups: a token's exact count and level,
and the levels of bigrams. Scoring mixes the bigram's relative frequency with the smoothed
one of the word.

base_score uses exact counts: log10((c + 0.5) / (N + 0.5 (V + 1))) summed over tokens.

Results in special cases: a null text counts as empty and has one token, its end; without
training rows all counts are 0; repeated rows count each; an empty table gives an empty
one; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, by_group, give_back, hash_share, materialise, mix, partitions, prefix_hashes, release, routed, span_hashes, with_answers, word_spans

FOLDS, HELD_OUT = 5, 1
#: The filter's hash functions, and bits spent on an n-gram.
HASHES, BITS_PER_GRAM = 3, 16
#: Weight of the bigram's relative frequency.
BIGRAM = 0.6
#: Tokens and bigrams gathered before they are sent on, and bytes of text whose tokens are counted together.
GATHER, TOGETHER = 3_000_000, 4 << 20
#: Tasks per shuffle partition among which groups are dealt: a task's batch holds what its groups hold.
SPREAD = 4
END = np.uint64(0x7E57AB1E0FC0FFEE)
START = np.uint64(0x0DDBA11C0DE0F00D)
#: A listed bigram is told by its leading 40 bits among those of its group.
SHORT = np.uint64(24)
COUNTED = "bucket int, g long, grams binary, counts binary, bigrams binary, pairs binary, held binary"
ANSWERED = "g long, payload binary, tokens long, distinct long"



def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every token: a row's words in lower case, then its end."""
    start, end, row = word_spans(data, offsets)
    words = span_hashes(prefix_hashes(LOWER[data]), start, end) if len(start) else np.zeros(0, np.uint64)
    rows = len(offsets) - 1
    last = np.searchsorted(row, np.arange(1, rows + 1))
    return np.insert(words, last, END), np.insert(row, last, np.arange(rows))


def token_runs(texts: pa.Array, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, rows from there) for runs of rows of about step bytes; hashed fewer bytes at a time, as that takes many times their size."""
    kept, first, size = [], 0, 0
    for lo, hi, data, offsets in buffers(texts):
        if kept and size + len(data) > step:
            yield (first, *map(np.concatenate, zip(*kept, strict=True)))
            kept, first, size = [], lo, 0
        words, rows = tokens(data, offsets)
        kept.append((words, rows + (lo - first)))
        size += len(data)
    if kept:
        yield (first, *map(np.concatenate, zip(*kept, strict=True)))


def bigrams(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it, or the row's start."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.concatenate(([True], rows[1:] != rows[:-1]))[: len(words)]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def summed(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their counts."""
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    new = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return v[new], np.add.reduceat(c, new) if len(new) else c


def summed_in_ranges(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """summed() of arrays in order, a sixteenth of the values at a time, so that few copies are held at once."""
    edges = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    cuts = [[0, *np.searchsorted(v, edges).tolist(), len(v)] for v in values]
    done = [summed([v[c[k] : c[k + 1]] for v, c in zip(values, cuts, strict=True)], [n[c[k] : c[k + 1]].astype(np.int64) for n, c in zip(counts, cuts, strict=True)]) for k in range(16)]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: zeros and the leading bytes of ordered values compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type, count: int | None = None, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    count = (len(raw) - at) // size if count is None else count
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, count * size, at).reshape(size, count).T).view(kind).reshape(count)


def dealt(values: np.ndarray, counts: np.ndarray, buckets: int) -> dict[int, tuple[bytes, bytes]]:
    to = (values >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    values, counts = values[order], counts[order].astype(np.uint32)
    return {b: (planes(values[edges[b] : edges[b + 1]]), planes(counts[edges[b] : edges[b + 1]])) for b in range(buckets) if edges[b] < edges[b + 1]}


def gather(buckets: int):  # noqa: ANN201
    """Batches of (g, training, text) to a group's token and bigram counts and its held-out bigrams, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a group: tokens, bigrams of training rows, bigrams of held-out rows
        own: dict[int, tuple[tuple[list, list], ...]] = defaultdict(lambda: tuple(([], []) for _ in range(3)))
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # a group at a time, so that all of them are never held twice, nor sent as one batch
            types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            while own:
                g, kinds = own.popitem()
                parts = [dealt(*summed(*x), buckets) for x in kinds]
                del kinds
                rows = []
                for b in set().union(*parts):
                    found = [x.get(b, (None, None)) for x in parts]
                    rows.append((b, g, *found[0], *found[1], found[2][0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "g", "grams", "counts", "bigrams", "pairs", "held"])

        for batch in batches:
            group, training = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            for lo, words, rows in token_runs(batch.column(2), TOGETHER):
                two = bigrams(words, rows)
                learn = training[lo + rows].astype(bool)
                g = group[lo + rows]
                for one in np.unique(g).tolist():
                    mine = g == one
                    values, place = np.unique(words[mine], return_inverse=True)
                    counts = np.bincount(place, learn[mine], len(values)).astype(np.int64)
                    for kind, (v, c) in enumerate(((values, counts), *(np.unique(two[mine & x], return_counts=True) for x in (learn, ~learn)))):
                        own[one][kind][0].append(v)
                        own[one][kind][1].append(c.astype(np.uint32))
                        held += len(v)
                if held > GATHER:
                    yield from flush()
                    held = 0
                    give_back()
        yield from flush()
        give_back()

    return run


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(1, counts))).astype(np.int64)


def places(grams: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    return (mix(grams + np.uint64((level * HASHES + k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64)


def segment_bits(grams: int) -> int:
    """Bits of a segment."""
    return max(64, BITS_PER_GRAM * grams)


class Segment:
    """A bucket's part of the filter, and probes into it."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.bits = segment_bits(len(grams))
        self.cells = np.zeros(self.bits // 8 + 1, dtype=np.uint8)
        of = levels(counts)
        for level in range(1, int(of.max()) + 1 if len(of) else 1):
            here = grams[of >= level]
            for k in range(HASHES):
                self._set(places(here, level, k, self.bits))

    def _set(self, at: np.ndarray) -> None:
        """One bit of its byte at a time: equal places write the same."""
        for bit in range(8):
            own = at[(at & 7) == bit] >> 3
            self.cells[own] |= np.uint8(1 << bit)

    def _has(self, at: np.ndarray) -> np.ndarray:
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)

    def level(self, grams: np.ndarray) -> np.ndarray:
        """The highest level up to which the filter has each n-gram; 0 if it has none."""
        out = np.zeros(len(grams), dtype=np.uint8)
        alive, level = np.arange(len(grams)), 1
        while len(alive) and level < 64:
            for k in range(HASHES):
                alive = alive[self._has(places(grams[alive], level, k, self.bits))]
            out[alive] = level
            level += 1
        return out


def quantised(level: np.ndarray) -> np.ndarray:
    """Counts of levels: the middle of the level's range, 1 at the first."""
    return np.where(level == 0, 0.0, 1.5 * 2.0 ** (level.astype(np.float64) - 1) - 0.5)


def packed(words: np.ndarray, counts: np.ndarray, word_levels: np.ndarray, two: np.ndarray, two_levels: np.ndarray) -> bytes:
    """A bucket's answer to a group, for unpacked()."""
    sizes = np.array([len(words), len(two)], dtype=np.uint64)
    high, low = (two >> np.uint64(8)).astype(np.uint32), two.astype(np.uint8)
    return sizes.tobytes() + b"".join(planes(x) for x in (words, counts.astype(np.uint64), word_levels, high, low, two_levels))


def unpacked(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Tokens in order with counts and levels, and bigrams' leading bits in order with levels."""
    parts: tuple[list[np.ndarray], ...] = ([], [], [], [], [], [])
    for raw in raws:
        n, m = np.frombuffer(raw, dtype=np.uint64, count=2).tolist()
        at = 16
        for part, size, kind in zip(parts, (n, n, n, m, m, m), (np.uint64, np.uint64, np.uint8, np.uint32, np.uint8, np.uint8), strict=True):
            part.append(unplanes(raw, kind, size, at))
            at += part[-1].nbytes
    words, counts, word_levels, high, low, two_levels = (np.concatenate(x) for x in parts)
    two = high.astype(np.uint64) << np.uint64(8) | low
    one, pair = np.argsort(words), np.argsort(two)
    return words[one], counts[one].astype(np.float64), word_levels[one], two[pair], two_levels[pair]


def reduce_bucket(table: pa.Table) -> pa.Table:
    """A bucket's counts to its answers to the groups, and its totals.

    A bigram of a training row has level 1 at least, so it is listed from level 2 on; one of a
    held-out row is listed from level 1 on.
    """
    empty = np.zeros(0, np.uint64)
    values = lambda name, kind: [unplanes(x.as_py(), kind) if x.is_valid else empty.astype(kind) for x in table.column(name)]
    g = np.array(table.column("g").to_pylist())
    v, c = values("grams", np.uint64), values("counts", np.uint32)
    bv, bc, held = values("bigrams", np.uint64), values("pairs", np.uint32), values("held", np.uint64)
    del table
    words, counts = summed_in_ranges(v, c)
    two, pairs = summed_in_ranges(bv, bc)
    del c, bc
    known = counts > 0
    segment = Segment(np.concatenate((words[known], two)), np.concatenate((counts[known], pairs)))
    word_levels, two_levels = segment.level(words), segment.level(two)
    groups, payload = [], []
    order = np.argsort(g, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
        own = np.unique(np.concatenate([v[i] for i in mine]))
        at = np.searchsorted(words, own)
        seen = np.unique(np.concatenate([bv[i] for i in mine]))
        seen_levels = two_levels[np.searchsorted(two, seen)]
        asked = np.unique(np.concatenate([held[i] for i in mine]))
        asked_levels = segment.level(asked)
        listed = np.concatenate((seen[seen_levels > 1], asked[asked_levels > 0])) >> SHORT
        listed, first = np.unique(listed, return_index=True)
        listed_levels = np.concatenate((seen_levels[seen_levels > 1], asked_levels[asked_levels > 0]))[first]
        groups.append(int(g[mine[0]]))
        payload.append(packed(own, counts[at], word_levels[at], listed, listed_levels))
    n = len(payload)
    kinds = {"g": pa.int64(), "payload": pa.binary(), "tokens": pa.int64(), "distinct": pa.int64()}
    columns = {"g": [*groups, None], "payload": [*payload, None], "tokens": [None] * n + [int(counts.sum())], "distinct": [None] * n + [int(known.sum())]}
    out = pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()})
    del v, bv, held, payload, columns, segment
    give_back()
    return out


def looked_up(keys: np.ndarray, levels_: np.ndarray, asked: np.ndarray, default: np.ndarray) -> np.ndarray:
    """The levels of bigrams, and the default for those not listed."""
    if not len(keys):
        return default
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, levels_[at], default)


def scorer(total: int, distinct: int):  # noqa: ANN201
    """Rows with answers to their scores."""
    floor = np.log10(total + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(table: tuple[np.ndarray, ...], g: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
            n, known, base, score = [], [], [], []
            ends = table[2][np.searchsorted(table[0], END)]
            training = np.array([zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS != HELD_OUT for x in ids.to_pylist()], dtype=bool)
            for lo, hi, data, offsets in buffers(texts):
                words, rows = tokens(data, offsets)
                at = np.searchsorted(table[0], words)
                count, single = table[1][at], quantised(table[2][at])
                size = hi - lo
                n.append(np.bincount(rows, minlength=size))
                known.append(np.bincount(rows, count > 0, size))
                base.append(np.bincount(rows, np.log10(count + 0.5) - floor, size))
                before = np.empty_like(single)
                before[1:] = single[:-1]
                new = np.concatenate(([True], rows[1:] != rows[:-1]))
                before[new] = max(1.0, float(quantised(ends)))  # as many starts as ends
                two = quantised(looked_up(table[3], table[4], bigrams(words, rows) >> SHORT, training[lo + rows].astype(np.uint8)))
                share = np.minimum(1.0, np.divide(two, before, out=np.zeros_like(two), where=before > 0))
                # where the word before is unknown, the word alone decides
                weight = np.where(before > 0, BIGRAM, 0.0)
                p = weight * share + (1 - weight) * np.minimum(1.0, (single + 0.5) / 10**floor)
                score.append(np.bincount(rows, np.log10(p), size))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(known).astype(np.int64)), pa.array(np.concatenate(base)), pa.array(np.concatenate(score))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

        yield from by_group(batches, unpacked, step)
        give_back()

    return run


def language_model_scores(documents: DataFrame) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = documents.sparkSession
    parts = partitions(spark)
    rows = routed(documents)
    held = hash_share(F.col("doc_id"), FOLDS) == HELD_OUT
    counted = rows.select("g", (~held).alias("training"), "text").mapInArrow(gather(parts), COUNTED)
    reduced = materialise(counted.groupBy("bucket").applyInArrow(reduce_bucket, ANSWERED), "counts")
    del counted
    release(spark)
    total, distinct = reduced.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).collect()[0]
    answers = reduced.where(F.col("payload").isNotNull()).select("g", "payload")
    scored = with_answers(rows, answers, SPREAD * parts).mapInArrow(scorer(total, distinct), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (hash_share(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
