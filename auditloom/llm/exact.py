"""Exact dedup by content-defined chunk recipes.

A text without white space is cut where a rolling hash of its last bytes says so, so
equal passages are cut alike wherever they stand. Chunks are deduplicated to a dictionary:
one identifier for each distinct chunk that occurs more than once, told by a 128-bit BLAKE2
digest and verified by a second, independent 64-bit hash and the length, so that chunks
which share a digest alone get identifiers of their own. A document with a chunk that occurs
nowhere else equals no other. The ordered identifier lists (8 bytes a chunk) of the others
are compared, and their SHA-256 last; no text is moved.

Results in special cases: a null text counts as empty, and all empty texts are equal;
of equal texts the row with the most code points, then the smallest doc_id stays (a null
doc_id after all others, of rows that tie the one that stands first); exact_groups() marks
rows that repeat the doc_id that stays as kept too, exact_rows() tells rows apart; a very
long text is a long list; an empty table gives an empty one; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buffers, identified, materialise, prefix_hashes, span_hashes, text_of, to_long

#: Bytes in the rolling window, mean bytes of a chunk (a power of two), and salts of the join back.
WINDOW, MEAN, SALTS = 32, 2048, 32
#: A chunk in more than one in so many places is looked up by broadcast: there are fewer than that of them.
LARGE = 1000
IDENTIFIER = 28
ROW = ("in_file", "at_row")
SCHEMA = "doc_id long, in_file long, at_row long, code_points long, text_sha256 string, recipe binary"


def cuts(sums: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ends of the chunks of bytes [start, end)."""
    if end - start <= WINDOW:
        return np.array([end])
    at = np.arange(start + WINDOW, end)
    marked = at[(span_hashes(sums, at - WINDOW, at) & np.uint64(MEAN - 1)) == 0]
    return np.append(marked, end)


def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points, shas, lists = [], [], []
        for _, _, data, offsets in buffers(batch.column(3)):
            starts = (data & 0xC0) != 0x80
            counted = np.concatenate(([0], np.cumsum(starts)))
            points.append(counted[offsets[1:]] - counted[offsets[:-1]])
            solid = ~SPACE[data]
            place = np.concatenate(([0], np.cumsum(solid)))[offsets]
            data = data[solid]
            sums, raw = prefix_hashes(data), data.tobytes()
            for s, e in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
                shas.append(hashlib.sha256(raw[s:e]).hexdigest())
                ends = cuts(sums, s, e)
                begins = np.concatenate(([s], ends[:-1]))
                second = to_long(span_hashes(sums, begins, ends)).tolist()
                lists.append(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() + v.to_bytes(8, "big", signed=True) + (b - a).to_bytes(4, "big") for a, b, v in zip(begins.tolist(), ends.tolist(), second, strict=True)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.concatenate(points) if points else np.zeros(0, np.int64), pa.int64()), pa.array(shas, pa.string()), pa.array(lists, pa.binary())],
            names=["doc_id", *ROW, "code_points", "text_sha256", "recipe"],
        )


def chunk_recipes(documents: DataFrame, names: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, where the row stands, code_points, text_sha256 and the recipe: 28 bytes for each chunk, in order."""
    rows, file, at = identified(documents, names)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(file).alias("in_file"), F.col(at).alias("at_row"), text_of().alias("text")).mapInArrow(recipes, SCHEMA)


def occurrences(found: DataFrame) -> DataFrame:
    """Where each chunk of the recipes stands: in_file, at_row, place, chunk (digest, verifier, length)."""
    place = F.explode(F.sequence(F.lit(0), (F.length("recipe") / IDENTIFIER - 1).cast("int")))
    chunk = F.expr(f"substring(recipe, place * {IDENTIFIER} + 1, {IDENTIFIER})")
    return found.select(*ROW, "recipe", place.alias("place")).select(*ROW, "place", chunk.alias("chunk"))


def chunk_dictionary(places: DataFrame) -> DataFrame:
    """chunk, id, places: the distinct chunks that occur more than once."""
    many = places.groupBy("chunk").agg(F.count("*").alias("places")).where("places > 1")
    return materialise(many.withColumn("id", F.monotonically_increasing_id()), "chunks")


def identifier_lists(found: DataFrame) -> DataFrame:
    """in_file, at_row, ids: the identifiers, in order, of rows whose chunks all occur more than once."""
    places = occurrences(found)
    chunks = chunk_dictionary(places)
    total = chunks.agg(F.coalesce(F.sum("places"), F.lit(0))).collect()[0][0]
    large = F.col("places") * LARGE > F.lit(total)
    # a chunk of a large group of copies doesn't meet in one task of the join with the others
    known = places.join(F.broadcast(chunks.where(large).select("chunk", F.col("id").alias("of_large"))), "chunk", "left")
    hot = known.where("of_large is not null").select(*ROW, "place", F.col("of_large").alias("id"))
    rest = known.where("of_large is null").join(chunks.where(~large).select("chunk", "id"), "chunk").select(*ROW, "place", "id")
    lists = hot.unionByName(rest).groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("list"))
    whole = lists.join(found.select(*ROW, (F.length("recipe") / IDENTIFIER).cast("int").alias("n")), [*ROW]).where(F.size("list") == F.col("n"))
    return whole.select(*ROW, F.transform("list", lambda x: x["id"]).alias("ids"))


def exact_rows(documents: DataFrame, names: tuple[str, str] | None = None) -> DataFrame:
    """One row per row: doc_id, where it stands (see identified), keep (that of the row that stays), group_size and text_sha256."""
    found = materialise(chunk_recipes(documents, names), "recipes")
    lists = materialise(found.drop("recipe").join(identifier_lists(found), [*ROW]), "lists")
    own = F.struct((-F.col("code_points")).alias("less"), F.col("doc_id").isNull().alias("without"), "doc_id", *ROW)
    groups = lists.groupBy("ids", "text_sha256").agg(F.min(own).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    # a group may hold a third of all rows: its members are dealt over several tasks
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lists.withColumn("salt", F.pmod(F.xxhash64(*ROW), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["ids", "text_sha256", "salt"]).select(*ROW, "keep", "group_size")
    return found.drop("recipe").join(joined, [*ROW], "left").select("doc_id", *ROW, F.coalesce("keep", own).alias("keep"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: keep_id, group_size, kept and text_sha256."""
    keep = F.col("keep.doc_id")
    return exact_rows(documents).select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
