"""Pages of a site whose skeletons agree place by place, by distances to pivots.

Two skeletons differ at d places (those that only the longer one has included) and are similar if d is
at most FAR tenths of the longer one's. d obeys the triangle inequality, so distances to a few pivots of the
site bound it from below: pairs that can't be similar are never compared, and blocks whose
ranges of distances lie too far apart never meet. Blocks are cut from the pivots' neighbourhoods, BLOCK skeletons
each on average, and a pair of blocks is one group, so a large site is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tenths of the longer skeleton that may differ.
FAR = 4
#: Pivots of a site, and distinct skeletons of a block, on average.
PIVOTS, BLOCK = 16, 256
#: Skeletons of a site that one task compares with the pivots, and those compared at a time.
PART, STEP = 4096, 512
PLACED = "site string, shape long, s string, ball int, dists array<int>"
COMPARED = "site string, a long, b long, same long, longer long"


def table(skeletons: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, one skeleton a row, 0 behind its end; lengths)."""
    codes = [np.frombuffer(s.encode("utf-32-le"), "<u4") for s in skeletons]
    sizes = np.array([len(c) for c in codes], np.int64)
    out = np.zeros((len(codes), int(sizes.max(initial=0))), "<u4")
    for k, c in enumerate(codes):
        out[k, : len(c)] = c
    return out, sizes


def distances(one: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places at which a row of characters differs from each of some rows."""
    width = min(len(one), rows.shape[1])
    return (rows[:, :width] != one[:width]).sum(axis=1) + (one[width:] != 0).sum() + (rows[:, width:] != 0).sum(axis=1)


def near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (site, part, rn, shape, s), a part's pivots (with rn) before its skeletons, to PLACED rows, STEP at a time."""
    of, pivots, theirs = None, [], None
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            rows = batch.slice(lo, STEP)
            keys, ranks = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), rows.column(2).to_pylist()
            first = 0
            while first < len(keys):
                last = first
                while last < len(keys) and keys[last] == keys[first] and (ranks[last] is None) == (ranks[first] is None):
                    last += 1
                own = rows.slice(first, last - first)
                if keys[first] != of:
                    of, pivots = keys[first], []
                if ranks[first] is not None:
                    pivots += own.column(4).to_pylist()
                    theirs = None
                else:
                    theirs = table(pivots)[0] if theirs is None else theirs
                    mine, _ = table(own.column(4).to_pylist())
                    d = np.stack([distances(t, mine) for t in theirs], axis=1).astype(np.int32)
                    dists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(3), own.column(4), pa.array(d.argmin(axis=1).astype(np.int32)), dists], names=["site", "shape", "s", "ball", "dists"])
                first = last


def placed(shapes: DataFrame) -> DataFrame:
    """PLACED: each skeleton's distances to its site's pivots, and the nearest one. shapes: site, shape, s.

    A site's skeletons are dealt out in parts of PART or so; the pivots go to each part once, not with every row.
    """
    first = Window.partitionBy("site").orderBy(F.xxhash64("s"), "shape")
    pivots = shapes.select("site", "shape", "s").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= PIVOTS)
    parts = shapes.groupBy("site").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    rows = shapes.join(parts, "site").select("site", F.pmod(F.xxhash64("s"), "parts").cast("int").alias("part"), F.lit(None).cast("int").alias("rn"), "shape", "s")
    sent = pivots.join(parts, "site").select("site", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rn", "shape", "s")
    n = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = sent.unionByName(rows).repartition(n, "site", "part").sortWithinPartitions("site", "part", F.col("rn").asc_nulls_last())
    return both.mapInArrow(near_pivots, PLACED)


def block_pairs(own: DataFrame) -> DataFrame:
    """site, i, j (i <= j) of the blocks that may hold a similar pair. own: placed() rows with block."""
    each = own.select("site", "block", F.length("s").alias("n"), F.posexplode("dists").alias("k", "d"))
    spans = each.groupBy("site", "block", "k").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("n").alias("n"))
    blocks = spans.groupBy("site", "block").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "low", "high"))), lambda x: F.struct(x["low"], x["high"])).alias("spans"))
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = F.transform(F.arrays_zip(F.col("x.spans").alias("p"), F.col("y.spans").alias("q")), lambda z: F.greatest(z["p"]["low"] - z["q"]["high"], z["q"]["low"] - z["p"]["high"]))
    near = F.array_max(apart) * 10 <= F.greatest("x.n", "y.n") * FAR
    both = x.join(y, (F.col("x.site") == F.col("y.site")) & (F.col("x.block") <= F.col("y.block")) & near)
    return both.select(F.col("x.site").alias("site"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))


def compare(chars: np.ndarray, sizes: np.ndarray, dists: np.ndarray, left: np.ndarray, right: np.ndarray, once: bool, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(x, y, differing places) of the similar pairs of rows left with rows right, and how many pairs were compared.

    once: left and right are the same rows, each pair counts once. forest: only pairs that connect
    what no pair before has connected, and the most similar pair.
    """
    label, best, top = np.arange(len(chars)), 2.0, None
    xs, ys, ds, compared = [], [], [], 0
    for x in left.tolist():
        to = right[right > x] if once else right
        longer = np.maximum(sizes[to], sizes[x])
        least = np.abs(dists[to] - dists[x]).max(axis=1)
        open_ = least * 10 <= longer * FAR
        if forest:
            open_ &= (label[to] != label[x]) | (least / longer < best)
        to, longer = to[open_], longer[open_]
        compared += len(to)
        if not len(to):
            continue
        d = distances(chars[x], chars[to])
        near = d * 10 <= longer * FAR
        to, longer, d = to[near], longer[near], d[near]
        if forest and len(to):
            k = int((d / longer).argmin())
            if d[k] / longer[k] < best:
                best, top = d[k] / longer[k], (x, int(to[k]), int(d[k]))
            new = [j for j, y in enumerate(to.tolist()) if label[y] != label[x] and not label.__setitem__(label == label[y], label[x])]
            to, d = to[new], d[new]
        xs.append(np.full(len(to), x))
        ys.append(to)
        ds.append(d)
    if top:
        xs, ys, ds = [*xs, [top[0]]], [*ys, [top[1]]], [*ds, [top[2]]]
    x, y, d = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (xs, ys, ds))
    return x, y, d, compared


def compared(shapes: DataFrame, forest: bool) -> DataFrame:
    """COMPARED: site, a, b (a < b), places that agree, and the longer one's, of similar distinct skeletons.

    With forest, a pair of blocks gives only its most similar pair and edges that connect what its pairs connect.
    """
    near = placed(shapes)
    size = near.groupBy("site", "ball").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = near.join(size, ["site", "ball"]).withColumn("block", F.xxhash64("ball", F.pmod(F.xxhash64("s"), "parts"))).select("site", "block", "shape", "s", "dists")
    ends = block_pairs(own).select("site", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sent = ends.join(own, ["site", "block"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        site, i, j = key
        chars, sizes = table(list(rows["s"]))
        ids, mine = rows["shape"].to_numpy(), rows["block"].to_numpy()
        x, y, d, _ = compare(chars, sizes, np.stack(list(rows["dists"])).astype(np.int64), np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j, forest)
        longer = np.maximum(sizes[x], sizes[y])
        return pd.DataFrame({"site": pd.Series([site] * len(x), dtype=object), "a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "same": longer - d, "longer": longer})

    # work grows faster than a group's rows, so small bytes mustn't merge groups into few tasks
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "site", "i", "j").groupBy("site", "i", "j").applyInPandas(run, COMPARED)
