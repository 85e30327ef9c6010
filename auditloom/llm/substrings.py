"""Removal of repeated substrings by a sparse suffix array in sorted buckets.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller
doc_id. Of the K-byte strings in every such window the one with the least hash is its
anchor; equal windows have equal anchors at equal places, so it is enough to sort the
suffixes that start at anchors, 1 byte in 14, and among them those whose anchor occurs in
two documents (a first pass counts anchors by hash, 5 bytes each, and tells each group of
rows which of its own are shared).

Those suffixes, each with the bytes before it that its windows need, are
range-partitioned by leading bytes at sampled splitters. A splitter lies between two
anchors, unless one anchor fills a bucket by itself. Each bucket is sorted by its leading
bytes, 8 at a time, ties alone by the next 8 (as multikey quicksort does, with numpy's sort
for the partitions); within a run of equal anchors, windows at the same place are grouped
and the least doc_id of each group found. Where a splitter cuts through a run, its windows
that share all bytes from the anchor on with the suffix at the border are compared across it.

A suffix that a group of rows holds many times travels once, with the least and greatest
doc_id; the answer, which windows are in which smaller doc_id, goes back to the group, which
finds the places again. So a passage in most documents costs a row for each group of rows.

Results in special cases: a null text counts as empty; an empty text has nothing removed;
a row without doc_id comes after all others; rows that repeat a doc_id don't count against
each other; a very long text is worked through in pieces of PIECE bytes; an empty table
gives an empty one; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPLITS, buffers, by_group, discard, ids_of, materialise, mix, partitions, prefix_hashes, release, routed, span_hashes, with_answers

#: Bytes of a repeated string, of an anchor, and anchors' places in a window.
LENGTH, K = 50, 24
PLACES = LENGTH - K + 1
LEFT = PLACES - 1
#: Hashes a task gathers before it sends them on; suffixes of a group that are compared before they are; rows that are hashed at once in a bucket.
GATHER, TOGETHER, ROWS = 2_000_000, 200_000, 20_000
#: Suffixes in the sample that splitters are taken from, and the groups of a file that give it.
SAMPLE, SAMPLED = 50_000, 1
#: Bytes that are hashed at once: some ten arrays of 8 bytes for each of them are held.
PIECE = 1 << 18
#: Rows of an Arrow batch while anchors are counted and compared: the JVM holds each batch several times over.
BATCH_ROWS = 1000
ORDER = np.uint64((1 << 24) - 1)
#: Bytes of a shipped suffix with its two bounds; the group of rows that holds it and how it calls it, and the least and greatest doc_id there.
WIDE = LENGTH + LEFT + 2
HELD = np.dtype([("g", "<i8"), ("id", "<u8"), ("least", "<i8"), ("most", "<i8")])
#: What a group is told: windows (by place) of a suffix that start in a smaller document, and that document.
TOLD = np.dtype([("id", "<u8"), ("doc", "<i8"), ("mask", "<i8")])
#: A window at a border.
OUTER = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("doc", "<i8"), ("g", "<i8"), ("id", "<u8"), ("place", "<i8")])
HASH_BYTES = 5
HASH_MASK = np.uint64((1 << 8 * HASH_BYTES) - 1)

SHARED = "g long, payload binary"
COUNTED = "bucket int, g long, hashes binary, many binary"
SUFFIXES = "bucket int, payload binary"
MARKS = "g long, bucket int, payload binary"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window's start, last window's start) of the anchors of all windows that lie within a row."""
    out = []
    for lo in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        piece = data[lo : lo + PIECE + LENGTH - 1]
        count = len(piece) - K + 1
        if count < PLACES:
            continue
        at = np.arange(count)
        hashes = span_hashes(prefix_hashes(piece), at, at + K)
        low = hashes & ~ORDER | at.astype(np.uint64)
        width = 1
        while width * 2 <= PLACES:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < PLACES:
            rest = PLACES - width
            low = np.minimum(low[:-rest], low[rest:])
        place = (low & ORDER).astype(np.int64)
        # windows that would cross the end of a row have no anchor
        cross = np.zeros(len(place) + 1, dtype=np.int32)
        ends = offsets[(offsets > lo) & (offsets < lo + len(piece))] - lo
        np.add.at(cross, np.clip(ends - LENGTH + 1, 0, len(place)), 1)
        np.add.at(cross, np.clip(ends, 0, len(place)), -1)
        start = np.flatnonzero(np.cumsum(cross[:-1]) == 0)
        if not len(start):
            continue
        place = place[start]
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((new[1:], [len(place)])) - 1
        out.append((place[new] + lo, hashes[place[new]], start[new] + lo, start[last] + lo))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // HASH_BYTES, 8), dtype=np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


def ask(buckets: int):  # noqa: ANN201
    """Batches of (g, doc_id, text) to the anchors in them, by bucket and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, list[np.ndarray]] = defaultdict(list)
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for g, parts in gathered.items():
                values, seen = np.unique(np.concatenate(parts), return_counts=True)
                to = (values % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                values, many = values[order], (seen[order] > 1)
                used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([g] * len(used), pa.int64()), pa.array([packed(values[edges[b] : edges[b + 1]]) for b in used], pa.binary()), pa.array([np.packbits(many[edges[b] : edges[b + 1]]).tobytes() for b in used], pa.binary())],
                    names=["bucket", "g", "hashes", "many"],
                )
            gathered.clear()

        for batch in batches:
            group = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            for lo, _, data, offsets in buffers(batch.column(2), PIECE):
                place, hashes, _, _ = anchors(data, offsets)
                row = np.searchsorted(offsets, place, side="right") - 1
                values = hashes & HASH_MASK
                # once for each row
                order = np.lexsort((values, row))
                values, row = values[order], row[order]
                new = np.concatenate(([True], (values[1:] != values[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
                values, row = values[new], row[new]
                own = group[lo + row]
                for g in np.unique(own).tolist():
                    gathered[g].append(values[own == g])
                count += len(values)
                if count > GATHER:
                    yield from flush()
                    count = 0
        yield from flush()

    return run


def answer(table: pa.Table) -> pa.Table:
    """A bucket's anchors to those in more than one row, for each group that asked."""
    groups = table.column("g").to_pylist()
    parts = [unpacked(x) for x in table.column("hashes").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("many").to_pylist(), parts, strict=True)]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    shared = np.union1d(values[counts > 1], np.concatenate([p[m] for p, m in zip(parts, many, strict=True)]))
    out = defaultdict(list)
    for g, p in zip(groups, parts, strict=True):
        if len(shared):
            out[g].append(p[shared[np.minimum(np.searchsorted(shared, p), len(shared) - 1)] == p])
    kept = {g: packed(np.unique(np.concatenate(x))) for g, x in out.items()}
    kept = {g: x for g, x in kept.items() if x}
    return pa.table({"g": pa.array(list(kept), pa.int64()), "payload": pa.array(list(kept.values()), pa.binary())})


def named(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """What a group calls a suffix: a hash of all its windows' bytes and their places."""
    return mix(span_hashes(prefix_hashes(data), first, last + LENGTH) + ((place - last) * 64 + place - first).astype(np.uint64))


def suffixes(splitters: list[bytes], every: int = 1):  # noqa: ANN201
    """Rows with answers to the suffixes at shared anchors, once for each group: 50 bytes from the anchor on, then the 26 before it.

    every: give only those whose name is a multiple of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(splitters, dtype=f"S{LENGTH + LEFT}")

        def step(shared: np.ndarray, g: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
            docs = ids_of(ids)
            if not len(shared):
                return
            known = lambda values: shared[np.minimum(np.searchsorted(shared, values), len(shared) - 1)] == values
            kept: list[tuple[np.ndarray, ...]] = []

            def flush() -> Iterator[pa.RecordBatch]:
                name, owner, body, near, far = (np.concatenate(x) for x in zip(*kept, strict=True))
                kept.clear()
                order = np.lexsort((owner, name))
                new = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
                lead = order[new]
                held = np.empty(len(new), dtype=HELD)
                held["g"], held["id"], held["least"] = g, name[lead], owner[lead]
                held["most"] = owner[order[np.append(new[1:], len(order)) - 1]]
                # sorted rows compress better on their way
                by = np.argsort(np.ascontiguousarray(body[lead]).view(f"S{LENGTH + LEFT}").ravel())
                lead, held = lead[by], held[by]
                bucket = np.searchsorted(bounds, np.ascontiguousarray(body[lead]).view(f"S{LENGTH + LEFT}").ravel(), side="right")
                # the suffix, and the least and most bytes by which its windows start before the anchor
                wide = np.concatenate((body[lead], near[lead, None].astype(np.uint8), far[lead, None].astype(np.uint8)), axis=1)
                used = np.unique(bucket)
                lo, hi = np.searchsorted(bucket, used), np.searchsorted(bucket, used, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed_rows(wide[i:j], held[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], names=["bucket", "payload"])

            count = 0
            # whole rows, or pieces of one: a suffix has the same name whatever it is read with
            for lo, hi, data, offsets in buffers(texts, PIECE):
                place, hashes, first, last = anchors(data, offsets)
                some = np.flatnonzero(known(hashes & HASH_MASK))
                name = named(data, place[some], first[some], last[some])
                if every > 1:
                    some, name = some[name % np.uint64(every) == 0], name[name % np.uint64(every) == 0]
                if not len(some):
                    continue
                place = place[some]
                owner = docs[lo:hi][np.searchsorted(offsets, place, side="right") - 1]
                near, far = place - last[some], place - first[some]
                at = place[:, None] + np.concatenate((np.arange(LENGTH), np.arange(-LEFT, 0)))
                inside = (at >= (place - far)[:, None]) & (at < (place - near)[:, None] + LENGTH)
                kept.append((name, owner, np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8), near, far))
                count += len(some)
                if count > TOGETHER:
                    yield from flush()
                    count = 0
            if kept:
                yield from flush()

        yield from by_group(batches, lambda raws: np.unique(np.concatenate([unpacked(x) for x in raws])) if raws else np.zeros(0, np.uint64), step)

    return run


def chosen(sample: list[bytes], parts: int) -> list[bytes]:
    """At most parts - 1 splitters: quantiles of the sample, moved to where their anchor begins unless a splitter is there already."""
    sample, out = sorted(sample), []
    for k in range(1, parts):
        if sample:
            s = sample[min(len(sample) - 1, k * len(sample) // parts)]
            cut = s[:K] if not out or s[:K] > out[-1] else s
            if not out or cut.rstrip(b"\0") > out[-1].rstrip(b"\0"):
                out.append(cut)
    return out


def packed_rows(wide: np.ndarray, held: np.ndarray) -> bytes:
    """Suffixes in order, and byte by byte what is known of them, compressed; all are of one group."""
    names = [held["id"], held["least"], held["most"] - held["least"]]
    raw = [np.array([held["g"][0], len(wide)], dtype=np.int64).tobytes(), wide.tobytes(), *(np.ascontiguousarray(x).view(np.uint8).reshape(len(wide), 8).T.tobytes() for x in names)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpacked_rows(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    wides, helds = [], []
    for payload in payloads:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=np.uint8)
        g, n = raw[:16].view(np.int64).tolist()
        wides.append(raw[16 : 16 + n * WIDE].reshape(n, WIDE))
        names = np.ascontiguousarray(raw[16 + n * WIDE :].reshape(3, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(3, n)
        held = np.empty(n, dtype=HELD)
        held["g"], held["id"], held["least"], held["most"] = g, names[0].view(np.uint64), names[1], names[1] + names[2]
        helds.append(held)
    return np.concatenate(wides), np.concatenate(helds)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows by their words: ties in one word, and only they, are sorted by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    part = words[order, 0]
    groups = np.cumsum(np.concatenate(([0], (part[1:] != part[:-1]).astype(np.int64)))) if len(part) else np.zeros(0, np.int64)
    for k in range(1, words.shape[1]):
        sizes = np.bincount(groups) if len(groups) else np.zeros(0, np.int64)
        tied = np.flatnonzero(sizes[groups] > 1)
        if not len(tied):
            break
        value = words[order[tied], k]
        sub = np.lexsort((value, groups[tied]))
        order[tied] = order[tied][sub]
        value, own = value[sub], groups[tied][sub]
        step = np.zeros(len(order), dtype=np.int64)
        step[tied[1:]] = (own[1:] == own[:-1]) & (value[1:] != value[:-1])
        fresh = np.zeros(len(order), dtype=np.int64)
        fresh[1:] = groups[1:] != groups[:-1]
        groups = np.cumsum(fresh + step)
    return order


def compare(splitters: list[bytes], parts: int):  # noqa: ANN201
    """A bucket of suffixes to what each group of rows is told, and windows at the borders that cut through a run, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        bucket = np.concatenate([np.asarray(b.column(0).to_numpy()) for b in batches])
        wide, held = unpacked_rows([x for b in batches for x in b.column(1).to_pylist()])
        body, near, far = wide[:, : LENGTH + LEFT], wide[:, -2].astype(np.int64), wide[:, -1].astype(np.int64)
        # a splitter of an anchor's bytes alone lies before all of that anchor's suffixes
        cut = [k for k, b in ((0, int(bucket.min()) - 1), (-1, int(bucket.max()))) if 0 <= b < len(splitters) and len(splitters[b]) > K]
        del batches
        padded = np.zeros((len(body), 80), dtype=np.uint8)
        padded[:, : LENGTH + LEFT] = body
        words = padded.view(">u8").astype(np.uint64)
        order = multikey_order(words)
        lead = words[order, : K // 8]
        new = np.concatenate(([True], (lead[1:] != lead[:-1]).any(axis=1)))
        run_of = np.cumsum(new) - 1
        del words, padded, lead
        runs = int(run_of[-1]) + 1
        several = np.bincount(run_of, 1 + (held["least"] < held["most"])[order], minlength=runs)
        border = np.isin(run_of, [run_of[k] for k in cut])
        told: list[np.ndarray] = []
        outer: list[np.ndarray] = []
        at = 0
        while at < len(order):
            # whole runs at a time
            stop = int(np.searchsorted(run_of, run_of[min(at + ROWS, len(order)) - 1], side="right"))
            busy = np.flatnonzero((several[run_of[at:stop]] > 1) | border[at:stop])
            mine = order[at:stop][busy]
            at = stop
            if not len(mine):
                continue
            # equal windows beyond a border share their bytes from the anchor on with the row at that border
            reach = np.zeros(len(mine), dtype=np.int64)
            for k in cut:
                same = body[mine, :LENGTH] == body[order[k], :LENGTH]
                reach = np.maximum(reach, np.where(same.all(axis=1), LENGTH, same.argmin(axis=1)))
            turned = np.concatenate((body[mine, LENGTH:], body[mine, :LENGTH]), axis=1)
            sums = prefix_hashes(np.ascontiguousarray(turned).ravel())
            start = np.arange(len(mine)) * (LENGTH + LEFT) + LEFT
            own = held[mine]
            rows, bounds, bits = [], [], []
            for o in range(PLACES):
                here = np.flatnonzero((near[mine] <= o) & (o <= far[mine]))
                if not len(here):
                    continue
                window = span_hashes(sums, start[here] - o, start[here] - o + LENGTH)
                _, place = np.unique(window, return_inverse=True)
                low = np.full(place.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, place, own["least"][here])
                bound = low[place]
                late = own["most"][here] > bound
                rows.append(here[late])
                bounds.append(bound[late])
                bits.append(np.full(int(late.sum()), 1 << o, dtype=np.int64))
                # the least of these may have equals in other buckets
                edge = np.flatnonzero((reach[here] >= LENGTH - o) & (own["least"][here] == bound))
                if len(edge):
                    found = np.empty(len(edge), dtype=OUTER)
                    e = own[here[edge]]
                    found["w1"], found["w2"], found["doc"], found["g"], found["id"], found["place"] = window[edge], mix(window[edge] + np.uint64(o + 1)), bound[edge], e["g"], e["id"], o
                    outer.append(found)
            if rows:
                told.append(_told(own, *(np.concatenate(x) for x in (rows, bounds, bits))))
        yield from sent(told)
        if outer:
            found = np.concatenate(outer)
            to = (found["w1"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(parts + 1))
            yield _marks(bucket=np.unique(to).astype(np.int32), payload=[found[order[edges[b] : edges[b + 1]]].tobytes() for b in np.unique(to).tolist()])

    return run


def _told(own: np.ndarray, row: np.ndarray, bound: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """(g, id, doc, mask): the windows of each suffix by the document in which they start."""
    order = np.lexsort((bound, row))
    row, bound, bit = row[order], bound[order], bit[order]
    out = np.zeros(0, dtype=[("g", "<i8"), *TOLD.descr])
    if len(row):
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (bound[1:] != bound[:-1]))))
        out = np.empty(len(new), dtype=out.dtype)
        out["g"], out["id"], out["doc"], out["mask"] = own["g"][row[new]], own["id"][row[new]], bound[new], np.bitwise_or.reduceat(bit, new)
    return out


def sent(told: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What groups are told, a row for each group."""
    all_ = np.concatenate(told) if told else np.zeros(0, dtype=np.int64)
    if len(all_):
        all_ = all_[np.lexsort((all_["id"], all_["g"]))]
        edges = np.flatnonzero(np.concatenate(([True], all_["g"][1:] != all_["g"][:-1])))
        ends = np.append(edges[1:], len(all_))
        payload = np.empty(len(all_), dtype=TOLD)
        for name in TOLD.names:
            payload[name] = all_[name]
        yield _marks(g=all_["g"][edges], payload=[payload[a:b].tobytes() for a, b in zip(edges.tolist(), ends.tolist(), strict=True)])


def _marks(**columns) -> pa.RecordBatch:  # noqa: ANN003
    n = len(columns["payload"])
    kinds = {"g": pa.int64(), "bucket": pa.int32(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def across(table: pa.Table) -> pa.Table:
    """A bucket of windows at borders to what groups are told of them."""
    found = np.frombuffer(b"".join(table.column("payload").to_pylist()), dtype=OUTER)
    order = np.lexsort((found["doc"], found["w2"], found["w1"]))
    found = found[order]
    new = np.concatenate(([True], (found["w1"][1:] != found["w1"][:-1]) | (found["w2"][1:] != found["w2"][:-1])))
    least = found["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.flatnonzero(found["doc"] > least)
    batches = list(sent([_told(found, late, least[late], np.int64(1) << found["place"][late])]))
    return pa.Table.from_batches(batches or [_marks(payload=[])]).select(["g", "payload"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what their group is told to what is left of them."""

    def prepare(raws: list[bytes]) -> np.ndarray:
        told = np.frombuffer(b"".join(raws), dtype=TOLD)
        return told[np.argsort(told["id"], kind="stable")]

    def step(told: np.ndarray, g: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        out = []
        docs = ids_of(ids)
        for lo, hi, data, offsets in buffers(texts, PIECE):
            gone = np.zeros(len(data), dtype=bool)
            if len(told):
                place, _, first, last = anchors(data, offsets)
                name = named(data, place, first, last)
                begin, end = (np.searchsorted(told["id"], name, side=side) for side in ("left", "right"))
                some = np.flatnonzero(begin < end)
                at = np.repeat(some, end[some] - begin[some])
                of = told[np.arange(len(at)) + np.repeat(begin[some] - np.concatenate(([0], np.cumsum(end[some] - begin[some])))[:-1], end[some] - begin[some])]
                owner = docs[lo:hi][np.searchsorted(offsets, place[at], side="right") - 1]
                late = owner > of["doc"]
                at, mask = place[at][late], of["mask"][late]
                if len(at):
                    step_ = np.zeros(len(data) + 1, dtype=np.int64)
                    for o in range(PLACES):
                        s = at[(mask >> o & 1).astype(bool)] - o
                        np.add.at(step_, s, 1)
                        np.add.at(step_, s + LENGTH, -1)
                    gone = np.cumsum(step_[:-1]) > 0
            for k in range(hi - lo):
                own, off = data[offsets[k] : offsets[k + 1]], gone[offsets[k] : offsets[k + 1]]
                spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if len(off) else 0
                out.append((len(own), int(off.sum()), spans, hashlib.sha256(own[~off].tobytes() if spans else own.tobytes()).hexdigest()))
        a, b, c, d = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return by_group(batches, prepare, step)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches have at most BATCH_ROWS rows; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def repeated_substrings(documents: DataFrame) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and kept_sha256."""
    spark = documents.sparkSession
    parts = partitions(spark)
    rows = routed(documents)
    asked = rows.mapInArrow(ask(parts), COUNTED)
    with small_batches(spark):
        shared = materialise(asked.groupBy("bucket").applyInArrow(answer, SHARED), "shared")
    # splitters from one group of rows of each file: SAMPLE suffixes or so
    known = (shared.agg(F.sum(F.length("payload"))).collect()[0][0] or 0) // HASH_BYTES
    some = routed(documents, SAMPLED)
    told = shared.join(some.select("g").distinct(), "g", "left_semi")
    sample = with_answers(some, told).mapInArrow(suffixes([], max(1, known // SPLITS // SAMPLE)), SUFFIXES)
    wide = [unpacked_rows([bytes(r["payload"])])[0] for r in sample.collect()]
    splitters = chosen([x[: LENGTH + LEFT].tobytes() for w in wide for x in w], parts)
    found = with_answers(rows, shared).mapInArrow(suffixes(splitters), SUFFIXES)
    with small_batches(spark):
        marks = materialise(found.repartitionById(parts, "bucket").mapInArrow(compare(splitters, parts), MARKS), "marks")
    discard(shared)
    del found
    release(spark)
    borders = marks.where(F.col("bucket").isNotNull()).groupBy("bucket").applyInArrow(across, SHARED)
    answers = marks.where(F.col("g").isNotNull()).select("g", "payload").unionByName(borders)
    return with_answers(rows, answers).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
