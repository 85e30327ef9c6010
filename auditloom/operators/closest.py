"""The most alike two pages of each site, by bounds that tighten: no gram's pages are all paired.

A pair that was verified bounds the best similarity of its site from below. Pages can only
do as well if they share one of their rarest grams (of a page of n grams, m of them on other pages too, the
m - ceil(t n) + 1 rarest; t is the bound), and if sizes and what is left of both after that
gram allow it. Grams on one page only never leave the page. Lists of more than LIST pages
are compared block by block, blocks of sizes that can't reach the bound left out, and
each pair of blocks gives its best pair alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Pages of a gram that are paired with each other; what is verified of each site for a first bound.
LIST, FIRST = 64, 8
#: Places in a list that count as near.
NEAR = 4
#: Sizes within this factor share a block.
STEP = 1.1
SLACK = 1e-9


def similarity(k: Column, na: Column, nb: Column) -> Column:
    return k / (na + nb - k)


def twins(sets: DataFrame) -> DataFrame:
    """site, a, b: the first two pages of a site with the same set, by a, then b."""
    first = Window.partitionBy("site", "digest").orderBy("page_id")
    two = sets.select("site", "digest", "page_id").withColumn("rn", F.row_number().over(first)).where("rn <= 2")
    pairs = two.groupBy("site", "digest").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.count("*").alias("c")).where("c = 2")
    return pairs.groupBy("site").agg(F.min(F.struct("a", "b")).alias("p")).select("site", "p.a", "p.b")


def shared_grams(sets: DataFrame) -> DataFrame:
    """site, page_id, n, m, shared: the grams that other pages of the site have too, rarest first."""
    long = sets.select("site", "page_id", "n", F.explode("grams").alias("gram"))
    often = long.groupBy("site", "gram").agg(F.count("*").alias("f")).where("f > 1")
    own = long.join(often, ["site", "gram"]).groupBy("site", "page_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("shared"))
    return own.withColumn("m", F.size("shared"))


def _verified(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """site, a, b, similarity of pairs (site, a, b)."""
    side = lambda x: shared.select("site", F.col("page_id").alias(x), F.col("n").alias(f"n{x}"), F.transform("shared", lambda g: g["gram"]).alias(f"g{x}"))
    both = pairs.join(side("a"), ["site", "a"]).join(side("b"), ["site", "b"])
    return both.select("site", "a", "b", similarity(F.size(F.array_intersect("ga", "gb")), F.col("na"), F.col("nb")).alias("similarity"))


def _best(pairs: DataFrame) -> DataFrame:
    """site, similarity, a, b: the best pair of each site, the first of several."""
    best = pairs.groupBy("site").agg(F.max(F.struct("similarity", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("x"))
    return best.select("site", "x.similarity", (-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b"))


def first_bounds(shared: DataFrame) -> DataFrame:
    """site, bound: a similarity that a pair of the site reaches; of neighbours in the lists of grams the likeliest pairs are verified."""
    lists = shared.select("site", "page_id", "n", F.explode("shared").alias("g")).select("site", "page_id", "n", "g.gram", F.pmod(F.xxhash64("page_id"), F.ceil(F.col("g.f") / LIST)).alias("part"))
    before = Window.partitionBy("site", "gram", "part").orderBy("page_id").rowsBetween(-NEAR, -1)
    earlier = lists.withColumn("earlier", F.collect_list(F.struct(F.col("page_id").alias("a"), F.col("n").alias("na"))).over(before))
    near = earlier.select("site", F.explode("earlier").alias("x"), F.col("page_id").alias("b"), F.col("n").alias("nb")).select("site", "x.a", "x.na", "b", "nb")
    counted = near.groupBy("site", "a", "b", "na", "nb").agg(F.count("*").alias("k"))
    likely = Window.partitionBy("site").orderBy(F.desc(similarity(F.col("k"), F.col("na"), F.col("nb"))), "a", "b")
    top = counted.withColumn("rn", F.row_number().over(likely)).where(F.col("rn") <= FIRST).select("site", "a", "b")
    return _best(_verified(top, shared)).select("site", F.col("similarity").alias("bound"))


def prefixes(shared: DataFrame, bounds: DataFrame) -> DataFrame:
    """site, gram, page_id, n, left, bound: the grams of which a pair that reaches the bound shares one; left: shared grams from there on."""
    need = F.ceil(F.col("bound") * F.col("n") - SLACK).cast("int")
    own = shared.join(bounds, "site").withColumn("need", F.greatest(F.lit(1), need)).where("m >= need")
    cut = F.posexplode(F.slice("shared", F.lit(1), F.col("m") - F.col("need") + 1)).alias("pos", "g")
    return own.select("site", "page_id", "n", "m", "bound", cut).select("site", "g.gram", "page_id", "n", (F.col("m") - F.col("pos")).alias("left"), "bound")


def _can_reach(na: Column, nb: Column, left: Column, bound: Column) -> Column:
    return (F.least(na, nb) >= bound * F.greatest(na, nb) - SLACK) & (left >= bound / (1 + bound) * (na + nb) - SLACK)


def _paired(lists: DataFrame) -> DataFrame:
    """site, a, b: pairs of the pages of short lists that can reach the bound."""
    x, y = lists.alias("x"), lists.alias("y")
    fits = _can_reach(F.col("x.n"), F.col("y.n"), F.least("x.left", "y.left"), F.col("x.bound"))
    both = x.join(y, (F.col("x.site") == F.col("y.site")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.page_id") < F.col("y.page_id")) & fits)
    return both.select(F.col("x.site").alias("site"), F.col("x.page_id").alias("a"), F.col("y.page_id").alias("b")).distinct()


def block_pairs(lists: DataFrame) -> DataFrame:
    """site, gram, i, j of the blocks of long lists that can hold a pair which reaches the bound."""
    blocks = lists.groupBy("site", "gram", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("left"), F.first("bound").alias("bound"))
    x, y = blocks.alias("x"), blocks.alias("y")
    sizes = (F.col("x.high") >= F.col("x.bound") * F.col("y.low") - SLACK) & (F.col("y.high") >= F.col("x.bound") * F.col("x.low") - SLACK)
    left = F.least("x.left", "y.left") >= F.col("x.bound") / (1 + F.col("x.bound")) * (F.col("x.low") + F.col("y.low")) - SLACK
    both = x.join(y, (F.col("x.site") == F.col("y.site")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.block") <= F.col("y.block")) & sizes & left)
    return both.select(F.col("x.site").alias("site"), F.col("x.gram").alias("gram"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))


def best_of_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The best pair of two blocks (site, gram, i, j), if one reaches the bound; rows: page_id, n, left, bound, block, grams."""
    _, _, i, j = key
    bound = float(rows["bound"].iloc[0])
    ids, n, left = (rows[c].to_numpy() for c in ("page_id", "n", "left"))
    grams = [np.sort(np.asarray(g)) for g in rows["grams"]]
    blocks, best = rows["block"].to_numpy(), None
    right = np.arange(len(rows)) if i == j else np.flatnonzero(blocks == j)
    for x in np.flatnonzero(blocks == i):
        to = right[ids[right] > ids[x]] if i == j else right
        fits = (np.minimum(n[to], n[x]) >= bound * np.maximum(n[to], n[x]) - SLACK) & (np.minimum(left[to], left[x]) >= bound / (1 + bound) * (n[to] + n[x]) - SLACK)
        for y in to[fits]:
            k = len(np.intersect1d(grams[x], grams[y], assume_unique=True))
            found = (k / (n[x] + n[y] - k), -min(ids[x], ids[y]), -max(ids[x], ids[y]))
            if found[0] >= bound - SLACK and (best is None or found > best):
                best, bound = found, max(bound, found[0])
    rows_ = [] if best is None else [(key[0], -best[1], -best[2], best[0])]
    return pd.DataFrame(rows_, columns=["site", "a", "b", "similarity"])


def _blockwise(lists: DataFrame, shared: DataFrame) -> DataFrame:
    """site, a, b, similarity: the best pairs of long lists (prefix entries with f, the list's length)."""
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(STEP)))
    block = F.xxhash64(size, F.pmod(F.xxhash64("page_id"), F.ceil(F.col("f") / LIST)))
    own = stored(lists.withColumn("block", block).drop("f"), "long-lists")
    pairs = block_pairs(own)
    ends = pairs.select("site", "gram", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    members = ends.join(own, ["site", "gram", "block"]).join(shared.select("site", "page_id", F.transform("shared", lambda g: g["gram"]).alias("grams")), ["site", "page_id"])
    columns = ["site", "gram", "i", "j", "page_id", "n", "left", "bound", "block", "grams"]
    return members.select(*columns).groupBy("site", "gram", "i", "j").applyInPandas(best_of_blocks, "site string, a long, b long, similarity double")


def closest_pairs(sets: DataFrame) -> DataFrame:
    """site, similarity, a, b: of each site the two pages with the highest Jaccard similarity of their sets, of several the first by a, then b.

    sets: site, page_id, grams (distinct numbers), digest (equal for equal sets). Sites whose
    pages share nothing have no row.
    """
    sets = stored(sets.select("site", "page_id", "grams", "digest", F.size("grams").alias("n")).where("n > 0"), "sets")
    same = stored(twins(sets), "twins")
    shared = stored(shared_grams(sets.join(same.select("site"), "site", "left_anti")), "shared-grams")
    bounds = first_bounds(shared)
    entries = stored(prefixes(shared, bounds), "prefixes")
    lists = entries.join(entries.groupBy("site", "gram").agg(F.count("*").alias("f")).where("f > 1"), ["site", "gram"])
    pairs = _verified(_paired(lists.where(F.col("f") <= LIST)), shared)
    long = lists.where(F.col("f") > LIST)
    if not long.isEmpty():
        pairs = pairs.unionByName(_blockwise(long, shared))
    return _best(pairs).unionByName(same.select("site", F.lit(1.0).alias("similarity"), "a", "b"))
