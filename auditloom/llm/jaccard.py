"""Exact n-gram Jaccard join by token-combination prefixes, and its connected components.

A document's tokens are its distinct word n-grams, in an order in which rare tokens come
first, then common, then frequent ones. A set of n tokens that links with others shares
at least two tokens with each of them within its first n - need + 2 (need: the least
overlap). So it is enough to index the rare and common tokens there one by one and the
frequent ones by pairs. A token is common or frequent if one in COMMON or FREQUENT
documents has it early in its order, as far as tasks have seen it there, and it is among
the MOST most common. Any classes give right links; these keep the lists short.

Equal sets are one class from the start. Within an index list, sets whose sizes and
sketches (parity bits, in number about the set's size and 1024 at least; their Hamming
distance never exceeds the sets' difference) allow a link are joined to clusters; what
goes on is a forest of such pairs, not all of them. The list of a key that more than LIST
sets have is cut into shares, and each two shares are compared in a task of their own. A set
lies in one cluster, so its text moves once, to the task that settles its cluster: there sets
that aren't joined yet are compared, nearest first, and verified exactly.

A cluster of more than CLUSTER sets (or TOKENS tokens) is split first. Its sets are
compared with a centre, in as many tasks as it takes, and listed anew by what they differ
in from it: two sets that link, and don't both link with the centre, share enough of those
tokens to meet in a list. Two that both link with it are joined by that and aren't compared
again. The lists give smaller clusters, and so on; all rounds read the texts of clusters from
a table of their own. So no link between
sets is lost, and copies never meet in all pairs in more than a task's share.

Results in special cases: a null text counts as empty; an empty set links with nothing;
equal texts and repeated rows link; a row without doc_id is no component's smallest
unless all are without; rows that repeat a doc_id count each by its own text; very long
texts are taken whole (a set and its sketch are held, not its text); an empty table gives
an empty one; columns other than doc_id and text are not read.
"""


from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, components, discard, identified, materialise, mix, ngram_hashes, partitions, prefix_hashes, release, span_hashes, text_of, to_long, word_spans

#: A token is common or frequent if one in so many documents has it early in its order, and no fewer than LEAST do.
COMMON, FREQUENT, LEAST = 4000, 200, (8, 64)
#: Most common tokens held by tasks.
MOST = 500_000
#: Bits of a sketch at least, and 64-bit words of wide ones that are compared first.
SKETCH, SHORT = 1024, 16
#: Sets of a list that one task compares, those that are compared in all pairs, and sets and tokens of a cluster that one task settles.
LIST, SMALL, CLUSTER, TOKENS = 8192, 8, 16384, 8_000_000
#: Sets and tokens in the sample that a cluster's centre is chosen from, and the Jaccard distance from it beyond which sets are far.
SAMPLE, SAMPLE_TOKENS, FAR = 256, 2_000_000, 0.5
#: A class of more than one in so many documents is looked up by broadcast.
LARGE = 1000
PROFILE = "doc_id long, in_file long, at_row long, n long, sid long, check long, sketch binary, bucket int, tokens binary, counts binary"
#: Tokens gathered before they are sent on.
GATHER = 2_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every row; a row of fewer words has one, of them all."""
    start, end, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    if not len(start):
        return [np.zeros(0, np.uint64)] * rows
    words = span_hashes(prefix_hashes(LOWER[data]), start, end)
    at, grams = ngram_hashes(words, row, size)
    edges = np.searchsorted(row[at], np.arange(rows + 1))
    begin = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for k in range(rows):
        count = int(begin[k + 1] - begin[k])
        if count >= size:
            out.append(np.unique(grams[edges[k] : edges[k + 1]]))
        elif count:
            own = words[begin[k] : begin[k + 1]]
            out.append(mix(ngram_hashes(own, np.zeros(count, np.int64), count)[1] + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set that tell sets apart."""
    a, b = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), mix(tokens ^ np.uint64(0x14057B7EF767814F))
    return int(a.sum().view(np.int64)) if len(a) else 0, int(b.sum().view(np.int64)) if len(b) else 0


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens' places among SKETCH bits, or half as many bits as tokens or more: a power of two."""
    bits = max(SKETCH, 1 << (max(1, len(tokens) // 2) - 1).bit_length())
    return np.packbits(np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


class Sketches:
    """Sketches of several widths; two are compared in the width of the smaller one."""

    def __init__(self, blobs: list[bytes]) -> None:
        width = np.array([len(b) * 8 for b in blobs], dtype=np.int64)
        self.width, self.place, self.rows = width, {}, {}
        for w in np.unique(width).tolist():
            # sizes of linked sets differ too little for more than one fold; all have the least width
            of = np.flatnonzero((width == w) | (width == 2 * w)) if w > SKETCH else np.arange(len(blobs))
            self.place[w] = np.full(len(blobs), -1, dtype=np.int64)
            self.place[w][of] = np.arange(len(of))
            self.rows[w] = np.stack([self._fold(blobs[k], w) for k in of.tolist()])
        if len(blobs) and SKETCH not in self.rows:
            self.place[SKETCH] = np.arange(len(blobs))
            self.rows[SKETCH] = np.stack([self._fold(b, SKETCH) for b in blobs])

    @staticmethod
    def _fold(blob: bytes, w: int) -> np.ndarray:
        """Halves added modulo two until w bits are left: what a sketch of w bits would be."""
        bits = np.frombuffer(blob, dtype=np.uint64)
        while len(bits) * 64 > w:
            half = len(bits) // 2
            bits = bits[:half] ^ bits[half:]
        return bits

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many tokens the sets i and j differ in at least, pair by pair."""
        out = np.bitwise_count(self.rows[SKETCH][i] ^ self.rows[SKETCH][j]).sum(axis=1, dtype=np.int64)
        least = np.minimum(self.width[i], self.width[j])
        for w in np.unique(least[least > SKETCH]).tolist():
            a, b = self.place[w][i], self.place[w][j]
            at = np.flatnonzero((least == w) & (a >= 0) & (b >= 0))
            out[at] = np.bitwise_count(self.rows[w][a[at]] ^ self.rows[w][b[at]]).sum(axis=1, dtype=np.int64)
        return out


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _blobs(keys: np.ndarray, values: np.ndarray, buckets: int, salt: np.ndarray | int = 0) -> list[tuple[int, bytes, bytes]]:
    to = (((keys >> np.uint64(8)) + np.uint64(7919) * np.asarray(salt, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    keys, values = keys[order], values[order]
    return [(b, keys[edges[b] : edges[b + 1]].tobytes(), values[edges[b] : edges[b + 1]].tobytes()) for b in range(buckets) if edges[b] < edges[b + 1]]


def profile(size: int, num: int, den: int, buckets: int):  # noqa: ANN201
    """Rows to their sets' sizes, digests and sketches, and counts of the tokens early in the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        early: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(early), return_counts=True) if early else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            # what is common in the corpus is so in some of these shares of it
            often = counts >= max(2, len(early) // (2 * COMMON))
            values, counts = values[often], counts[often]
            early.clear()
            b, k, c = zip(*_blobs(values, counts.astype(np.int64), buckets), strict=True) if len(values) else ((), (), ())
            none = pa.nulls(len(b), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 6 + [pa.nulls(len(b), pa.binary()), pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=names)

        names = ["doc_id", "in_file", "at_row", "n", "sid", "check", "sketch", "bucket", "tokens", "counts"]
        for batch in batches:
            ns, sids, checks, sketches = [], [], [], []
            for _, _, data, offsets in buffers(batch.column(3)):
                for s in shingle_sets(data, offsets, size):
                    n = len(s)
                    a, b = digest(s)
                    ns.append(n)
                    sids.append(a)
                    checks.append(b)
                    sketches.append(sketch(s))
                    if n > 1:
                        early.append(s[: n - least_overlap(n, num, den) + 2])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            if sum(map(len, early)) > GATHER:
                yield flush()
        yield flush()

    return run


def _counted(least: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), dtype=np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int64)
        values, place = np.unique(tokens, return_inverse=True)
        total = np.bincount(place, counts)
        return pa.table({"token": pa.array(to_long(values[total >= least]), pa.int64()), "places": pa.array(total[total >= least].astype(np.int64))})

    return run


def _in(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), dtype=bool)


class Index:
    """Which tokens are common and frequent, and how many documents have each of the common ones early."""

    def __init__(self, counted: dict[int, int], least: list[int]) -> None:
        self.common = np.array(sorted(counted), dtype=np.uint64)
        self.places = np.array([counted[int(t)] for t in self.common], dtype=np.int64)
        self.frequent = self.common[self.places >= least[1]]

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """Documents known to have each token early; 0 for rare ones."""
        if not len(self.common):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.common, tokens), len(self.common) - 1)
        return np.where(self.common[at] == tokens, self.places[at], 0)

    def keys(self, s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """The index keys of a set, and a bound of how many sets a key known as common has: rare and common tokens of its extended prefix, and pairs of frequent ones."""
        n = len(s)
        if n < 2:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        take = min(n, n - least_overlap(n, num, den) + 2)
        many = self.count(s)
        usual = many > 0
        if not usual.any():
            return s[:take], many[:take]
        hot = _in(s, self.frequent)
        order = np.concatenate((np.flatnonzero(~usual), np.flatnonzero(usual & ~hot)))[:take]
        often = np.flatnonzero(hot)[: take - len(order)]
        if len(often) < 2:
            return s[order], many[order]
        i, j = (often[k] for k in np.triu_indices(len(often), 1))
        return np.concatenate((s[order], mix(s[i] * np.uint64(0x9E3779B97F4A7C15) + s[j]))), np.concatenate((many[order], np.minimum(many[i], many[j])))


def index(size: int, num: int, den: int, known: Index, buckets: int):  # noqa: ANN201
    """Texts to (bucket, hot, keys, sids). The sets of a key that more than LIST have are dealt over several buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[], [], []]

        def flush() -> pa.RecordBatch:
            rows = []
            if kept[0]:
                keys, owners, many = (np.concatenate(x) for x in kept)
                for hot in (False, True):
                    of = np.flatnonzero((many > LIST) == hot)
                    salt = mix(owners[of].view(np.uint64)) % (many[of] // LIST + 1).astype(np.uint64) if hot else np.zeros(len(of), np.uint64)
                    rows += [(b, hot, k, s) for b, k, s in _blobs(keys[of], owners[of], buckets, salt)]
                for x in kept:
                    x.clear()
            b, h, k, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(h, pa.bool_()), pa.array(k, pa.binary()), pa.array(s, pa.binary())], names=["bucket", "hot", "keys", "sids"])

        count = 0
        for batch in batches:
            for _, _, data, offsets in buffers(batch.column(0)):
                for s in shingle_sets(data, offsets, size):
                    found, many = known.keys(s, num, den)
                    if len(found):
                        for x, y in zip(kept, (found, np.full(len(found), digest(s)[0], dtype=np.int64), many), strict=True):
                            x.append(y)
                        count += len(found)
                        if count > GATHER:
                            yield flush()
                            count = 0
        yield flush()

    return run


def lists(table: pa.Table) -> pa.Table:
    """A bucket of the index to its lists of two sets or more.

    kind 0: key, a: the list's least set, b: a set of it; kind 1: a set b of a list that is too long for one task, or of this bucket's share of one.
    """
    flags = np.array(table.column("hot").to_pylist(), dtype=bool)
    columns = [table.column(c).to_pylist() for c in ("keys", "sids")]
    out = []
    for hot in (False, True):
        at = np.flatnonzero(flags == hot)
        keys, sids = (np.frombuffer(b"".join(c[k] for k in at), dtype=t) for c, t in zip(columns, (np.uint64, np.int64), strict=True))
        if not len(keys):
            continue
        order = np.lexsort((sids, keys))
        keys, sids = keys[order], sids[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])))
        keys, sids = keys[new], sids[new]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((first, [len(keys)])))
        hub = np.repeat(sids[first], sizes)
        long = np.repeat(hot | (sizes > LIST), sizes)
        out += [(0, keys, hub, sids, np.repeat(sizes > 1, sizes) & ~long), (1, keys, hub, sids, long)]
    parts = [(np.full(int(m.sum()), kind, dtype=np.int32), to_long(k[m]), h[m], s[m]) for kind, k, h, s, m in out]
    kind, key, a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), *(np.zeros(0, np.int64),) * 3)
    return pa.table({"kind": pa.array(kind), "key": pa.array(key, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m tokens whose sketches are apart by so many bits may link."""
    # linked sets differ in at most (den - num) / (den + num) of both sizes
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((den + num) * apart.astype(np.int64) <= (den - num) * (n + m))


class Forest:
    """Labels of nodes 0 to n - 1, joined step by step."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        if a != b:
            self.of[self.of == max(a, b)] = min(a, b)


def near(num: int, den: int):  # noqa: ANN201
    """Lists as (hub, id, n, sketch, keys, tied), all of a hub's in one table, to pairs that join sets which may link.

    Two tied sets are joined already: they aren't compared. A hub's lists of more than SMALL sets give the
    edges of a forest that joins the same sets as all their other pairs that may link.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("hub")
        keys = table.column("keys").combine_chunks()
        counts = np.diff(np.asarray(keys.offsets))
        row = np.repeat(np.arange(table.num_rows), counts)
        key, hub = keys.values.to_numpy(zero_copy_only=False), table.column("hub").to_numpy()
        ids, n, tied = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("tied").to_numpy(zero_copy_only=False)
        bits = Sketches(table.column("sketch").to_pylist())
        order = np.lexsort((ids[row], key, hub[row]))
        row, key = row[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (hub[row[1:]] != hub[row[:-1]]))) if len(row) else np.zeros(0, bool))
        sizes = np.diff(np.concatenate((first, [len(row)])))
        pairs = []
        for size in range(2, SMALL + 1):
            at = first[sizes == size]
            pairs += [np.stack((row[at + i], row[at + j])) for i in range(size) for j in range(i + 1, size)]
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        i, j = (np.ascontiguousarray(x) for x in both)
        may = may_link(n[i], n[j], bits.apart(i, j), num, den) & ~(tied[i] & tied[j])
        left, right = [i[may]], [j[may]]
        label = np.arange(len(ids))
        for lo, size in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            own = row[lo : lo + size]
            own = own[np.argsort(n[own], kind="stable")]
            was = label[own]
            of, last, bound = was.copy(), np.searchsorted(n[own] * num, n[own] * den, side="right"), tied[own]
            for k in range(size - 1):
                if (of == of[0]).all():
                    break
                rest = np.arange(k + 1, last[k])
                rest = rest[(of[rest] != of[k]) & ~(bound[rest] & bound[k])]
                if len(rest):
                    rest = rest[may_link(n[own[rest]], n[own[k]], bits.apart(np.full(len(rest), own[k]), own[rest]), num, den)]
                if len(rest):
                    rest = rest[np.unique(of[rest], return_index=True)[1]]
                    left.append(np.full(len(rest), own[k]))
                    right.append(own[rest])
                    same = np.isin(of, np.append(of[rest], of[k]))
                    of[same] = of[same].min()
            # the hub's other lists need not join these sets again
            old, at = np.unique(was, return_index=True)
            begin, end = np.searchsorted(hub, hub[own[0]]), np.searchsorted(hub, hub[own[0]], side="right")
            place = np.minimum(np.searchsorted(old, label[begin:end]), len(old) - 1)
            label[begin:end] = np.where(old[place] == label[begin:end], of[at][place], label[begin:end])
        a, b = ids[np.concatenate(left)], ids[np.concatenate(right)]
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def joined(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The components of a cluster of sets: the least place of each set's. Exact."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    forest = Forest(len(sets))
    last = np.searchsorted(n[order] * num, n[order] * den, side="right")
    if len(sets) > SMALL:
        # wide enough that tokens which tell sets apart seldom fall together
        bits = max(SKETCH, 1 << (8 * max(1, int(np.median(n)) * (den - num) // den)).bit_length())
        rows = np.stack([np.packbits(np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.uint64) for s in sets])
        folded = np.bitwise_xor.reduce(rows.reshape(len(sets), -1, SHORT), axis=1)
    for k, i in enumerate(order.tolist()):
        rest = order[k + 1 : last[k]]
        rest = rest[forest.of[rest] != forest.of[i]]
        if len(sets) > SMALL and len(rest):
            apart = np.bitwise_count(folded[rest] ^ folded[i]).sum(axis=1, dtype=np.int64)
            rest = rest[may_link(n[rest], n[i], apart, num, den)]
            apart = np.bitwise_count(rows[rest] ^ rows[i]).sum(axis=1, dtype=np.int64)
            may = may_link(n[rest], n[i], apart, num, den)
            rest = rest[may][np.argsort(apart[may], kind="stable")]
        for j in rest.tolist():
            if forest.of[j] != forest.of[i] and linked(sets[i], sets[j], num, den):
                forest.join(i, j)
    return forest.of


def settle(size: int, num: int, den: int):  # noqa: ANN201
    """Rows (cluster, cid, text) in order, to (cid, root): the least set of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, cids, sets = None, [], []

        def flush() -> pa.RecordBatch:
            root = np.array(cids, dtype=np.int64)[joined(sets, num, den)] if cids else np.zeros(0, np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(root, pa.int64())], names=["cid", "root"])
            cids.clear()
            sets.clear()
            return out

        for batch in batches:
            of, cid = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, _, data, offsets in buffers(batch.column(2)):
                for k, s in enumerate(shingle_sets(data, offsets, size), lo):
                    if of[k] != cluster:
                        yield flush()
                        cluster = of[k]
                    cids.append(cid[k])
                    sets.append(s)
        yield flush()

    return run


def centre(size: int):  # noqa: ANN201
    """A sample of a cluster's sets to the one nearest to what most of them have, and the tokens in which it differs from that."""

    def run(table: pa.Table) -> pa.Table:
        cids, texts = table.column("cid").to_pylist(), table.column("text").combine_chunks()
        sets = [s for _, _, data, offsets in buffers(texts) for s in shingle_sets(data, offsets, size)]
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        most = tokens[2 * counts > len(sets)]
        apart = [len(np.setxor1d(s, most, assume_unique=True)) for s in sets]
        best = min(range(len(sets)), key=lambda k: (apart[k], cids[k]))
        often = tokens[10 * counts > len(sets)]
        return pa.table({"cluster": table.column("cluster")[:1], "cid": pa.array([cids[best]], pa.int64()), "own": pa.array([sets[best].tobytes()], pa.binary()), "odd": pa.array([np.setxor1d(sets[best], most, assume_unique=True).tobytes()], pa.binary()), "often": pa.array([often.tobytes()], pa.binary())})

    return run


def split(size: int, num: int, den: int):  # noqa: ANN201
    """Rows (cluster, salt, kind, cid, own, odd, often, text), each salt's centre first, to links with the centre (key null) and new lists.

    Let D be what a set and the centre differ in. Two sets with disjoint D's link only if both
    link with the centre; so other links share a token of their D's, and enough of them that
    the first few in any common order show one. That holds for sets near the centre; sets far
    from it are listed by their own first tokens, those that many sets of the cluster have last.
    """
    least = num / den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, odd, often = None, *(np.zeros(0, np.uint64),) * 3
        for batch in batches:
            kind, cid = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keys, members = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            link = []
            done = 0
            texts = batch.column(7)
            while done < batch.num_rows:
                if kind[done] == 0:
                    hub, own, odd, often = cid[done], *(np.frombuffer(batch.column(c)[done].as_py(), np.uint64) for c in (4, 5, 6))
                    salt = mix(np.array([hub], dtype=np.int64).view(np.uint64))
                    done += 1
                    continue
                stop = next((k for k in range(done, batch.num_rows) if kind[k] == 0), batch.num_rows)
                for lo, _, data, offsets in buffers(texts.slice(done, stop - done)):
                    for k, s in enumerate(shingle_sets(data, offsets, size), done + lo):
                        if cid[k] == hub:
                            continue
                        apart, n, m = np.setxor1d(s, own, assume_unique=True), len(s), len(own)
                        d, union = len(apart), (n + m + len(apart)) / 2
                        links = (den + num) * d <= (den - num) * (n + m)
                        if links:
                            link.append((hub, cid[k]))
                        made = []
                        if d <= (FAR + 1 - least + 1e-9) * union:
                            share = ((den + num) * d - (den - num) * (n - m)) // (2 * (den + num)) + 1
                            if not links:
                                share = min(share, -(-(num * d - n * (den - num)) // num))
                            take = d - max(1, share) + 1
                            common = _in(apart, odd)
                            made.append(mix(np.concatenate((apart[~common], apart[common]))[: max(0, take)] ^ salt))
                        if d > FAR * union:
                            common = _in(s, often)
                            made.append(mix(np.concatenate((s[~common], s[common]))[: n - least_overlap(n, num, den) + 1] ^ ~salt))
                        for x in made:
                            keys.append(x)
                            members.append(np.full(len(x), cid[k], dtype=np.int64))
                done = stop
            key = np.concatenate(keys)
            of = np.concatenate(members)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(link) + to_long(key).tolist(), pa.int64()), pa.array([x for x, _ in link] + of.tolist(), pa.int64()), pa.array([x for _, x in link] + [None] * len(key), pa.int64())],
                names=["key", "a", "b"],
            )

    return run


def _edges(members: DataFrame, num: int, den: int) -> DataFrame:
    """Lists (hub, id, n, sketch, keys) to pairs (a, b) of ids, all of a hub's lists in one group."""
    if "tied" not in members.columns:
        members = members.withColumn("tied", F.lit(False))
    return members.withColumn("part", F.pmod(F.xxhash64("hub"), F.lit(partitions(members.sparkSession) * 4))).groupBy("part").applyInArrow(near(num, den), "a long, b long")


def _shares(long: DataFrame) -> DataFrame:
    """Entries (key, id) of lists too long for one task to (hub, id, keys): a list's sets in shares, each two of which meet at a hub."""
    sized = long.join(long.groupBy("key").agg(F.ceil(F.count("*") / LIST).cast("int").alias("shares"), F.count("*").alias("m")).where("m > 1"), "key")
    own = sized.select("key", "id", "shares", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("own"))
    met = own.select("key", "id", "shares", "own", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("other")).where("shares = 1 or own <> other")
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("hub"), "id", F.array("key").alias("keys"))


def jaccard_rows(documents: DataFrame, size: int, num: int, den: int, names: tuple[str, str] | None = None) -> DataFrame:
    """One row per row: doc_id, in_file and at_row (see identified), n_shingles, and root: that of the row of its component with the least doc_id."""
    spark = documents.sparkSession
    parts = partitions(spark)
    rows, file, at = identified(documents, names)
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(file).alias("in_file"), F.col(at).alias("at_row"), text_of().alias("text"))
    seen = materialise(texts.mapInArrow(profile(size, num, den, parts), PROFILE), "profiles")
    docs = seen.where(F.col("bucket").isNull()).select("doc_id", "in_file", "at_row", "n", "sid", "check", "sketch")
    total = docs.count()
    least = [max(LEAST[0], total // (2 * COMMON)), max(LEAST[1], total // (2 * FREQUENT))]
    counted = seen.where(F.col("bucket").isNotNull()).select("bucket", "tokens", "counts")
    # bounded by MOST; a token beyond it counts as rare, and its list may be long
    usual = counted.groupBy("bucket").applyInArrow(_counted(least[0]), "token long, places long").orderBy(F.desc("places"), "token").limit(MOST).collect()
    known = Index({r["token"] & 0xFFFFFFFFFFFFFFFF: r["places"] for r in usual}, least)
    made = texts.select("text").mapInArrow(index(size, num, den, known, parts), "bucket int, hot boolean, keys binary, sids binary")
    posted = materialise(made.groupBy("bucket").applyInArrow(lists, "kind int, key long, a long, b long"), "lists")
    rep = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "in_file", "at_row")
    classes = docs.where("n > 0").groupBy("sid", "check", "n").agg(F.min(rep).alias("rep"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # sets that may link, by sid: two sets that share one are told apart when texts are compared
    listed = posted.where("kind = 0").groupBy(F.col("a").alias("hub"), F.col("b").alias("id")).agg(F.collect_list("key").alias("keys"))
    listed = listed.unionByName(_shares(posted.where("kind = 1").select("key", F.col("b").alias("id"))))
    clusters = components(_edges(listed.join(classes.select(F.col("sid").alias("id"), "n", "sketch"), "id"), num, den))
    members = materialise(classes.join(clusters.withColumnsRenamed({"node": "sid", "component": "cluster"}), "sid").select("cid", "cluster", "n", "sketch", "rep.in_file", "rep.at_row"), "members")
    discard(posted)
    found, links, kept = [], [], None
    while True:
        large = members.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).where((F.col("sets") > 2) & ((F.col("sets") > CLUSTER) | (F.col("tokens") > TOKENS)))
        large = materialise(large, "large")
        over = not large.isEmpty()
        small = members.join(large, "cluster", "left_anti") if over else members
        met = lambda x: texts.drop("doc_id").join(x.select("cluster", "cid", "in_file", "at_row").hint("merge"), ["in_file", "at_row"]).select("cluster", "cid", "text")
        if over and kept is None:
            kept = materialise(met(members).select("cid", "text"), "clustered")
        own = met(small) if kept is None else kept.join(small.select("cluster", "cid"), "cid").select("cluster", "cid", "text")
        found.append(materialise(own.repartition(parts, "cluster").sortWithinPartitions("cluster", "cid").mapInArrow(settle(size, num, den), "cid long, root long"), "settled"))
        if not over:
            break
        members = _split(kept, members.join(large, "cluster"), classes, links, size, num, den)
    release(spark)
    edges = found[0]
    if links:
        every = links[0]
        for x in links[1:] + [x.select(F.col("cid").alias("a"), F.col("root").alias("b")) for x in found]:
            every = every.unionByName(x)
        edges = components(every).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    labelled = classes.select("cid", "sid", "check", "n", "rep", "copies").join(edges, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("least"))
    # a class of one row outside all links is its own component; the others are looked up
    named = labelled.join(smallest, "root").where("copies > 1 or least <> rep").select("sid", "check", "n", F.col("least").alias("root"), "copies")
    return _labels(docs.drop("sketch"), materialise(named, "named"), total).select("doc_id", "in_file", "at_row", F.col("n").alias("n_shingles"), F.coalesce("root", rep).alias("root"))


def _split(texts: DataFrame, members: DataFrame, classes: DataFrame, links: list[DataFrame], size: int, num: int, den: int) -> DataFrame:
    """Members of clusters too large for one task to clusters that cover all their links but those with the centres, which go to links."""
    parts = partitions(texts.sparkSession)
    own = texts.join(members, "cid").select("cluster", "cid", "sets", "tokens", "text")
    # a sample of SAMPLE sets or so, fewer of large ones, and the least set
    first = members.groupBy("cluster").agg(F.min("cid").alias("first"))
    of = F.greatest(F.lit(1), F.ceil(F.col("sets") / F.least(F.lit(SAMPLE), F.greatest(F.lit(2), F.lit(SAMPLE_TOKENS) * F.col("sets") / F.col("tokens")))))
    sample = own.join(first, "cluster").where((F.pmod(F.xxhash64("cid"), of) == 0) | (F.col("cid") == F.col("first"))).select("cluster", "cid", "text")
    hubs = materialise(sample.groupBy("cluster").applyInArrow(centre(size), "cluster long, cid long, own binary, odd binary, often binary"), "centres")
    salts = F.col("sets") / F.lit(LIST)
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    blobs = ("own", "binary"), ("odd", "binary"), ("often", "binary")
    salted = own.select("cluster", F.pmod(F.xxhash64("cid"), F.ceil(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "cid", *none(*blobs), "text")
    large = members.select("cluster", "sets").distinct()
    spread = hubs.join(large, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), (F.ceil(salts) - 1).cast("int"))).alias("salt"), F.lit(0).alias("kind"), "cid", "own", "odd", "often", *none(("text", "string")))
    both = spread.unionByName(salted).repartition(parts, "cluster", "salt").sortWithinPartitions("cluster", "salt", "kind")
    out = materialise(both.mapInArrow(split(size, num, den), "key long, a long, b long"), "split")
    links.append(out.where(F.col("key").isNull()).select("a", "b"))
    keyed = out.where(F.col("key").isNotNull()).select("key", F.col("a").alias("id"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("hub")).where("m > 1")
    keyed = materialise(keyed.join(sizes, "key"), "lists")
    listed = keyed.where(F.col("m") <= LIST).groupBy("hub", "id").agg(F.collect_list("key").alias("keys")).unionByName(_shares(keyed.where(F.col("m") > LIST).select("key", "id")))
    tied = links[-1].select(F.col("b").alias("id"), F.lit(True).alias("tied")).distinct()
    sets = classes.select(F.col("cid").alias("id"), "n", "sketch").join(tied, "id", "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    clusters = components(_edges(listed.join(sets, "id"), num, den)).withColumnsRenamed({"node": "cid", "component": "cluster"})
    return materialise(members.drop("cluster", "sets", "tokens").join(clusters, "cid"), "members")


def jaccard_components(documents: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; sets link at a Jaccard similarity of num / den."""
    return jaccard_rows(documents, size, num, den).select("doc_id", "n_shingles", F.col("root.doc_id").alias("component_id"))


def _labels(docs: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """docs with the root of their classes, where those are named.

    Classes of more than one in LARGE documents are fewer than LARGE: they are broadcast.
    Their members and empty sets don't meet in one task of the join with the others.
    """
    keys, large = ["sid", "check", "n"], F.col("copies") * LARGE > total
    known = docs.join(F.broadcast(named.where(large).select(*keys, F.col("root").alias("of_large"), F.lit(True).alias("large"))), keys, "left")
    spread = F.when(F.col("large") | (F.col("n") == 0), 1 + F.pmod(F.xxhash64("in_file", "at_row"), F.lit(1 << 20))).otherwise(0)
    rest = named.where(~large).select(*keys, "root", F.lit(0).cast("long").alias("spread"))
    out = known.withColumn("spread", spread.cast("long")).join(rest, [*keys, "spread"], "left")
    return out.select("doc_id", "in_file", "at_row", "n", F.coalesce("of_large", "root").alias("root"))
