"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features are n-grams of words (1 and 2, lower-cased) and of word shapes (1 to 3: runs of
letters, capitals, digits and each other character), a repeated word being a gram of its
own; all are hashed into 2**BITS places and weighed by their share among the document's
n-grams. The model is fitted on at most MAX_LABELLED labelled rows (those with the
smallest hash of doc_id), in one task; scoring is a sparse dot product per document.

Results in special cases: a null text counts as empty; an empty text scores by the bias
alone; without any label the score is 0.5 for all; repeated rows each give a row; of
repeated labels of one doc_id the least counts; an empty table gives an empty one.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import LOWER, buffers, hash_share, mix, ngram_hashes, prefix_hashes, span_hashes, text_of, word_spans

BITS = 18
#: Bound of the labelled sample that the model is fitted on.
MAX_LABELLED = 8000
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 weights, and passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-4, 1e-4, 4
SCALE = 16.0

# every byte's class: small letters (and all beyond ASCII) a, capitals A, digits 0, others themselves
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every n-gram, in no order."""
    start, end, row = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = span_hashes(prefix_hashes(LOWER[data]), start, end)
    shape = SHAPE[data]
    change = np.ones(len(shape), dtype=bool)
    change[1:] = shape[1:] != shape[:-1]
    change[start] = True
    place = np.concatenate(([0], np.cumsum(change)))
    shapes = span_hashes(prefix_hashes(shape[change]), place[start], place[end])
    rows, grams = [], []
    for kind, hashes, sizes in ((1, words, (1, 2)), (2, shapes, (1, 2, 3))):
        for n in sizes:
            at, found = ngram_hashes(hashes, row, n)
            if kind == 1 and n == 2:
                found[hashes[at] == hashes[at + 1]] = 0  # a repeated word, whichever
            rows.append(row[at])
            grams.append(mix(found + np.uint64(97 * kind + n)))
    return np.concatenate(rows), (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, quality to doc_id, quality, places, values."""
    for batch in batches:
        places, values = [], []
        for lo, hi, data, offsets in buffers(batch.column(1)):
            rows, found = features(data, offsets)
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(hi - lo + 1))
            for k in range(hi - lo):
                place, count = np.unique(found[order[ends[k] : ends[k + 1]]], return_counts=True)
                places.append(place.astype(np.int32))
                values.append((count * (SCALE / max(1, count.sum()))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "quality", "places", "values"])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last is the bias) after PASSES over the examples."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(PASSES):
        for place, value, label in examples:
            place, value = np.append(place, 1 << BITS), np.append(value, 1.0)
            zi, ni = z[place], n[place]
            w = weights(zi, ni)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value)))))
            g = (p - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[place] = zi + g - sigma * w
            n[place] = ni + g * g
    return weights(z, n).astype(np.float32)


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        for doc, label, place, value in zip(*(batch.column(k) for k in range(4)), strict=True):
            examples.append((doc.as_py() or 0, np.asarray(place.values.to_numpy()), np.asarray(value.values.to_numpy(), dtype=np.float64), int(label.as_py() > 0)))
    # the order decides the result: by a hash of doc_id
    examples.sort(key=lambda x: (x[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, x[0]))
    yield pa.RecordBatch.from_arrays([pa.array([ftrl([x[1:] for x in examples]).tobytes()], pa.binary())], names=["weights"])


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learned from labelled rows outside the held-out fold."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (hash_share(F.col("doc_id"), FOLDS) != HELD_OUT))
    sample = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # at most MAX_LABELLED rows of two numbers
    marked = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    made = marked.mapInArrow(featurise, "doc_id long, quality int, places array<int>, values array<float>")
    got = made.repartition(1).mapInArrow(train, "weights binary").collect()  # one row of 2**BITS floats
    return np.frombuffer(got[0]["weights"], dtype=np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def with_scores(df: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score") -> DataFrame:
    """df with a last column of scores for its texts."""
    schema = StructType([*df.schema.fields]).add(score, DoubleType())
    column = df.columns.index(text)
    raw = weights.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(raw, dtype=np.float32)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in buffers(batch.column(column)):
                rows, found = features(data, offsets)
                total = np.bincount(rows, minlength=hi - lo)
                out[lo:hi] = np.bincount(rows, w[found], minlength=hi - lo) * SCALE / np.maximum(1, total) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=[*batch.schema.names, score])

    return df.mapInArrow(run, schema)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    weights = fit(documents, labels)
    scored = with_scores(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), weights)
    return scored.select("doc_id", (hash_share(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
