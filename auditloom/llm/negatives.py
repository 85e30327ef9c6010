"""Hard-negative mining by norm-bucketed search.

Vectors are scaled to whole numbers. An anchor's positives are the rows of its label with the
highest inner products; the negatives of a positive are the best rows of other labels whose
score lies in a window below the positive's. Candidates are dealt evenly over the tasks,
sorted by norm and cut into buckets; a task goes through its buckets from the largest norm down, for
a step of anchors at once, and leaves out a bucket for an anchor when, by Cauchy-Schwarz,
|anchor| times the bucket's largest norm is below the lower limit of each of the anchor's windows or
below the score of the k-th best found so far. Nothing else is left out, so results are exact.

Anchors go to the tasks in rounds of ROUND_BYTES at most, whatever their number, and each
round reads the buckets twice: for the positives, then for the negatives. Each task keeps
k rows an anchor and window; those of all tasks are ranked after a shuffle.

Rows with a null label, a null vector or a component that is null or not finite take no part, nor do
those whose squared scaled norm exceeds 2**62 (scores would not fit a long). Vectors of
different lengths count as filled up with zeros; an empty one scores 0. A row without an id comes after
all ids and comes back as null; it is no anchor. Each row is a row of its own, also beside an equal
one. Ties go to the smaller id. Empty tables give empty ones. Other columns are dropped, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, scratch

SCALE = 256
#: Rows whose id this divides are anchors.
EVERY = 100
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between LEAST and MOST hundredths of the positive's.
LEAST, MOST = 80, 100
#: Candidates of a bucket, and anchors that are scored against it at once.
BUCKET, STEP = 1024, 256
#: Bytes of anchors, at 8 a component, that a round sends to the tasks.
ROUND_BYTES = 16 << 20
#: Up to this product of two norms, 64-bit floating point adds the whole numbers exactly.
EXACT = float(1 << 52)
NO_ID, LOWEST = (1 << 63) - 1, -(1 << 63)

PACKED = "anchors boolean, part int, place int, n int, width int, largest double, rows binary, ids binary, labels binary, vectors binary"
FOUND = "anchor_row long, slot int, anchor_id long, positive_id long, positive_score long, score long, id long"


def prepared(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """id, label, v, norm: the rows that take part, scaled to whole numbers."""
    own = F.col("label") if label is None else label
    df = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), own.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    df = df.where("label is not null and x is not null").where(F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    df = df.select("id", "label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return df.select("id", "label", "v", square.alias("square")).where(F.col("square") <= float(1 << 62)).select("id", "label", "v", F.sqrt("square").alias("norm"))


def _smallest(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(initial=0)
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v, norm), norms falling, to buckets and to blocks of anchors; rows get a number of their own."""
    part, seen, places, waiting = TaskContext.get().partitionId(), 0, [0, 0], [[], []]

    def block(kind: int, own: list) -> Row:
        rows, ids, labels, vectors, norms = zip(*own, strict=True)
        width = max(map(len, vectors))
        table = np.zeros((len(own), width), np.int64)
        for k, v in enumerate(vectors):
            table[k, : len(v)] = v
        as_bytes = lambda x: np.array(x, np.int64).tobytes()
        places[kind] += 1
        return [bool(kind), part, places[kind] - 1, len(own), width, float(max(norms)), as_bytes(rows), as_bytes(ids), as_bytes(labels), _smallest(table).tobytes()]

    def batch(made: list) -> pa.RecordBatch:
        types = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

    for b in batches:
        made = []
        offsets, values = np.asarray(b.column(2).offsets), np.asarray(b.column(2).values)
        for k, (i, label, norm) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
            row = (part << 40 | seen, i, label, values[offsets[k] : offsets[k + 1]].copy(), norm)
            seen += 1
            for kind, most in ((0, BUCKET), (1, STEP)):
                if kind == 0 or (i != NO_ID and i % EVERY == 0):
                    waiting[kind].append(row)
                    if len(waiting[kind]) == most:
                        made.append(block(kind, waiting[kind]))
                        waiting[kind] = []
        if made:
            yield batch(made)
    if made := [block(kind, own) for kind, own in enumerate(waiting) if own]:
        yield batch(made)


class Block:
    """Vectors of a bucket or of a round's anchors, as numpy arrays."""

    def __init__(self, rows: list[Row]) -> None:
        ints = lambda name: np.concatenate([np.frombuffer(r[name], np.int64) for r in rows])
        self.rows, self.ids, self.labels = ints("rows"), ints("ids"), ints("labels")
        tables = [np.frombuffer(r["vectors"], {2: np.int16, 4: np.int32, 8: np.int64}[len(r["vectors"]) // max(1, r["n"] * r["width"]) or 8]).reshape(r["n"], r["width"]) for r in rows]
        self.v = np.zeros((len(self.rows), max(t.shape[1] for t in tables)))
        at = 0
        for t in tables:
            self.v[at : at + len(t), : t.shape[1]] = t
            at += len(t)
        self.norms = np.sqrt((self.v * self.v).sum(axis=1))
        self.largest = self.norms.max()
        # doubles hold components up to 2**53; beyond that whole numbers are kept beside them
        self.whole = None
        if np.abs(self.v).max(initial=0) >= 1 << 53:
            self.whole = np.zeros(self.v.shape, np.int64)
            at = 0
            for t in tables:
                self.whole[at : at + len(t), : t.shape[1]] = t
                at += len(t)

    def scores(self, some: np.ndarray, other: Block) -> np.ndarray:
        """Inner products of some rows with all rows of another block, exact."""
        width = min(self.v.shape[1], other.v.shape[1])
        if self.largest * other.largest <= EXACT:
            return (self.v[some, :width] @ other.v[:, :width].T).astype(np.int64)
        ints = lambda b: b.v.astype(np.int64) if b.whole is None else b.whole
        return ints(self)[some, :width] @ ints(other)[:, :width].T


class Best:
    """The best k (score, id) of each of n lists."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids, self.full = k, np.full((n, k), LOWEST), np.full((n, k), NO_ID), np.zeros(n, np.int64)

    def limits(self) -> np.ndarray:
        """What a score must reach to matter, by list."""
        return np.where(self.full == self.k, self.scores[:, -1], LOWEST)

    def offer(self, lists: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates (columns) for lists (rows), as far as they fit."""
        some = np.flatnonzero((fits := fits & (scores >= self.limits()[lists][:, None])).any(axis=1))
        if not len(some):
            return
        lists, scores, fits = lists[some], scores[some], fits[some]
        if scores.shape[1] > self.k:
            fitting = np.where(fits, scores, LOWEST)
            fits &= scores >= np.partition(fitting, -self.k, axis=1)[:, -self.k][:, None]
        r, c = np.nonzero(fits)
        old_r, old_c = np.nonzero(np.arange(self.k) < self.full[lists][:, None])
        r_, s_, i_ = np.concatenate((old_r, r)), np.concatenate((self.scores[lists][old_r, old_c], scores[r, c])), np.concatenate((self.ids[lists][old_r, old_c], ids[c]))
        order = np.lexsort((i_, -s_, r_))
        r_, s_, i_ = r_[order], s_[order], i_[order]
        at = np.arange(len(r_)) - np.searchsorted(r_, r_)
        kept = at < self.k
        self.scores[lists[r_[kept]], at[kept]], self.ids[lists[r_[kept]], at[kept]] = s_[kept], i_[kept]
        self.full[lists] = np.minimum(self.k, np.bincount(r_, minlength=len(lists)))

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of what was kept."""
        r, c = np.nonzero(np.arange(self.k) < self.full[:, None])
        return r, self.scores[r, c], self.ids[r, c]


def _bound(norms: np.ndarray, largest: float) -> np.ndarray:
    """At least the highest score by Cauchy-Schwarz, rounding included."""
    return norms * largest * (1 + 1e-9) + 1


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(len(batch)):
            yield Block([batch.slice(k, 1).to_pylist()[0]])


def positives_of(anchors: Block, buckets: Iterator[Block]) -> Best:
    """The best rows of each anchor's label but itself."""
    best = Best(len(anchors.rows), POSITIVES)
    for bucket in buckets:
        active = np.flatnonzero(_bound(anchors.norms, bucket.largest) >= best.limits())
        for lo in range(0, len(active), STEP):
            some = active[lo : lo + STEP]
            fits = (anchors.labels[some][:, None] == bucket.labels) & (anchors.rows[some][:, None] != bucket.rows)
            if fits.any():
                best.offer(some, anchors.scores(some, bucket), fits, bucket.ids)
    return best


def limits_of(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest score of a negative, by the positive's; without leaving 64 bits."""
    whole, rest = scores // 100, scores % 100
    return LEAST * whole - (-LEAST * rest // 100), MOST * whole + MOST * rest // 100


def negatives_of(anchors: Block, of: np.ndarray, slots: np.ndarray, scores: np.ndarray, buckets: Iterator[Block]) -> Best:
    """The best rows of other labels in each window: of, slots and scores tell its anchor, its place there, the positive's score."""
    best, (low, high) = Best(len(of), NEGATIVES), limits_of(scores)
    for bucket in buckets:
        active = np.flatnonzero((low <= high) & (_bound(anchors.norms[of], bucket.largest) >= np.maximum(low, best.limits())))
        wanted = np.unique(of[active])
        for lo in range(0, len(wanted), STEP):
            some = wanted[lo : lo + STEP]
            found = anchors.scores(some, bucket)
            other = anchors.labels[some][:, None] != bucket.labels
            here = active[(of[active] >= some[0]) & (of[active] <= some[-1])]
            for slot in range(POSITIVES):
                w = here[slots[here] == slot]
                if len(w):
                    at = np.searchsorted(some, of[w])
                    own = found[at]
                    best.offer(w, own, other[at] & (own >= low[w][:, None]) & (own <= high[w][:, None]), bucket.ids)
    return best


def _rounds(blocks: DataFrame) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Ranges (first, last) of (part, place) whose anchors take ROUND_BYTES at most; one row a part comes to the driver."""
    parts = blocks.groupBy("part").agg(F.count("*").alias("n"), F.max(F.col("n") * F.col("width") * 8).alias("size")).orderBy("part").collect()
    if not parts:
        return []
    most = max(1, ROUND_BYTES // max(1, max(p["size"] for p in parts)))
    out, first, left = [], None, most
    for p in parts:
        place = 0
        while place < p["n"]:
            first = (p["part"], place) if first is None else first
            take = min(left, p["n"] - place)
            place, left = place + take, left - take
            last = (p["part"], place - 1)
            if not left:
                out.append((first, last))
                first, left = None, most
    return out if first is None else [*out, (first, last)]


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of prepared() rows."""
    spark = rows.sparkSession
    dealt = rows.repartition(partitions(spark)).sortWithinPartitions(F.desc("norm"), "id")
    packed = materialise(dealt.mapInArrow(_packed, PACKED), "norm-buckets")
    buckets, blocks = packed.where("not anchors"), packed.where("anchors")
    path = None
    for (first_part, first_place), (last_part, last_place) in _rounds(blocks):
        part, place = F.col("part"), F.col("place")
        own = blocks.where(((part > first_part) | ((part == first_part) & (place >= first_place))) & ((part < last_part) | ((part == last_part) & (place <= last_place)))).orderBy("part", "place")
        anchors = Block(own.collect())  # ROUND_BYTES at most
        sent = spark.sparkContext.broadcast(anchors)

        def positives(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            r, s, i = positives_of(sent.value, _buckets(batches)).all()
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], names=["at", "score", "id"])

        best = Window.partitionBy("at").orderBy(F.desc("score"), "id")
        told = buckets.mapInArrow(positives, "at long, score long, id long").withColumn("slot", F.row_number().over(best) - 1).where(F.col("slot") < POSITIVES).toArrow()
        told = told.sort_by([("at", "ascending"), ("slot", "ascending")])
        windows = [told.column(c).to_numpy().astype(np.int64) for c in ("at", "slot", "score", "id")]  # POSITIVES an anchor
        sent_windows = spark.sparkContext.broadcast(windows)

        def negatives(batches: Iterator[pa.RecordBatch], sent=sent, sent_windows=sent_windows) -> Iterator[pa.RecordBatch]:
            anchors, (of, slots, scores, ids) = sent.value, sent_windows.value
            w, s, i = negatives_of(anchors, of, slots, scores, _buckets(batches)).all()
            columns = [anchors.rows[of[w]], slots[w], anchors.ids[of[w]], ids[w], scores[w], s, i]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], names=[c.split()[0] for c in FOUND.split(", ")])

        best = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id")
        found = buckets.mapInArrow(negatives, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
        path = path or scratch(spark, "negatives")
        given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        found.select("anchor_id", given("positive_id").alias("positive_id"), "rank", given("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").option("compression", "zstd").parquet(path)
        sent.unpersist()
        sent_windows.unpersist()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id EVERY divides, where every seventh id's label is off by one."""
    off = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(embeddings, off))
