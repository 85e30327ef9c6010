"""All pages of a site that share a gram, two by two, block against block: no row is shuffled for a pair.

Grams on one page only stay behind, and grams that stand on the same pages go as one kind with their
number, so that copied pages send little. A site's pages fall into blocks, and the pages of each two
blocks meet in one group, which counts what they share and gives its pairs piece by piece. So a page
is sent as often as its site has blocks: BLOCKS times, more only where a block would hold over MOST
kinds. What is shuffled grows with the pages, though the pairs may grow with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .batches import give_back

#: Blocks of a site, pages of a block below which there are fewer, and kinds of a block above which there are more.
BLOCKS, LEAST, MOST = 16, 256, 2_000_000
#: Meetings of equal kinds that are counted at a time.
ROOM = 1 << 20
PAIRS = "site string, a long, b long, similarity double"
_DIGITS = 10**6


def shared_sets(sets: DataFrame) -> DataFrame:
    """site, page_id, n, kinds: of sets (site, page_id, grams) what other pages of the site have too, as kinds of grams on the same pages and how many are of each; n: grams in all."""
    long = sets.where("site IS NOT NULL AND page_id IS NOT NULL").select("site", "page_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    # pages are told by sums of both halves of their hashes, which come out the same in any order
    page, every = F.xxhash64("page_id", "n"), Window.partitionBy("gram", "site")
    halves = {"f": F.count("*").over(every), "high": F.sum(F.shiftrightunsigned(page, 32)).over(every), "low": F.sum(page.bitwiseAND(F.lit((1 << 32) - 1))).over(every)}
    often = long.withColumns(halves).where("f > 1").select("site", "page_id", "n", F.xxhash64("f", "high", "low").alias("kind"))
    counted = often.repartition(_parts(often), "site", "page_id", "n").groupBy("site", "page_id", "n", "kind").agg(F.count("*").cast("int").alias("times"))
    return counted.groupBy("site", "page_id", "n").agg(F.collect_list(F.struct("kind", "times")).alias("kinds"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _spans(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[k] numbers from low[k] on, for each k."""
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def shared_counts(own: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], pages: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, k of pages that share k grams. own, other: kinds, whose they are and how many grams each is, by page; pages: of other."""
    order = np.argsort(other[0], kind="stable")
    kinds, to = other[0][order], other[1][order]
    low = np.searchsorted(kinds, own[0], "left")
    n = np.searchsorted(kinds, own[0], "right") - low
    at, times, low, n = own[1][n > 0], own[2][n > 0], low[n > 0], n[n > 0]
    done, start = np.cumsum(n), 0
    while start < len(at):
        before = done[start] - n[start]
        end = int(np.searchsorted(done, before + ROOM, "right"))
        if end < len(at):
            end = int(np.searchsorted(at, at[end], "left"))
        if end > start:
            first, rows = at[start], at[end - 1] - at[start] + 1
            found = np.repeat((at[start:end] - first) * pages, n[start:end]) + to[_spans(low[start:end], n[start:end])]
            each = np.repeat(times[start:end], n[start:end])
            if rows * pages <= 4 * len(found):
                counts = np.bincount(found, each)
                found = np.flatnonzero(counts)
                counts = counts[found]
            else:
                found, where = np.unique(found, return_inverse=True)
                counts = np.bincount(where, each)
            yield found // pages + first, found % pages, counts.astype(np.int64)
        else:  # more than ROOM of one page
            end, counts = int(np.searchsorted(at, at[start], "right")), np.zeros(pages)
            k = start
            while k < end:
                until = min(end, max(k + 1, int(np.searchsorted(done, done[k] - n[k] + ROOM, "right"))))
                counts += np.bincount(to[_spans(low[k:until], n[k:until])], np.repeat(times[k:until], n[k:until]), pages)
                k = until
            y = np.flatnonzero(counts)
            yield np.full(len(y), at[start]), y, counts[y].astype(np.int64)
        start = end


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Ids, sizes and kinds with their pages and numbers, pages by id."""
    rows = rows.sort_by("page_id").combine_chunks()
    lists = rows.column("kinds").combine_chunks()
    kinds = lists.flatten()
    return rows.column("page_id").to_numpy(), rows.column("n").to_numpy().astype(np.int64), (kinds.field("kind").to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), kinds.field("times").to_numpy())


def pairs_of_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks (site, i, j) of rows page_id, n, block, kinds; similarities are rounded half up, as round() does."""
    site, i, j = (k.as_py() for k in key)
    rows = pa.Table.from_batches(list(batches)).select(["page_id", "n", "block", "kinds"])
    mine = pc.equal(rows.column("block"), i)
    ids, sizes, own = _block(rows.filter(mine))
    others, their, other = (ids, sizes, own) if i == j else _block(rows.filter(pc.invert(mine)))
    del rows, mine
    for x, y, k in shared_counts(own, other, len(others)):
        if i == j:
            fits = ids[x] < others[y]
            x, y, k = x[fits], y[fits], k[fits]
        union = sizes[x] + their[y] - k
        parts = (2 * _DIGITS * k + union) // (2 * union) / _DIGITS
        a, b = np.minimum(ids[x], others[y]), np.maximum(ids[x], others[y])
        yield pa.RecordBatch.from_arrays([pa.array([site]).take(pa.array(np.zeros(len(a), np.int32))), pa.array(a), pa.array(b), pa.array(parts)], names=["site", "a", "b", "similarity"])
    give_back()


def sharing_pairs(sets: DataFrame) -> DataFrame:
    """site, a, b, similarity (six digits) of all pages a < b of a site that share a gram. sets: site, page_id, grams (distinct numbers)."""
    own = stored(shared_sets(sets), "shared-sets")
    sites = own.groupBy("site").agg(F.count("*").alias("pages"), F.sum(F.size("kinds")).alias("all"))
    blocks = F.greatest(F.least(F.lit(BLOCKS), F.ceil(F.col("pages") / LEAST)), F.ceil(F.col("all") / MOST)).cast("int")
    dealt = own.join(sites.select("site", blocks.alias("blocks")), "site").withColumn("block", F.pmod(F.xxhash64("page_id"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("site", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "page_id", "n", "block", "kinds")
    # a set number of partitions: few bytes make many pairs, so they mustn't merge into few tasks
    return sent.repartition(_parts(own), "site", "i", "j").groupBy("site", "i", "j").applyInArrow(pairs_of_blocks, PAIRS)
