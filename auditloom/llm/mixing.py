"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target number of words. A document's copies are a whole part that is
the same for its source, and a fractional one. The fractional parts are settled by the
pivotal method: of two undecided documents, words are moved at random from one to the
other, in expectation none, until one of them has a whole number of copies. That keeps
the source's words exactly. Documents are paired within blocks of bounded size; the one
undecided document that each block leaves goes on to a block of the next level, as in a
reduction tree, until one is left per source, which is rounded by itself. Long documents
come first in a block, so the one left over tends to be short, and a source's taken words
miss its target by less than that document.

Chance comes from hashes of doc_id, so reruns agree.

Results in special cases: a null text has no words and is taken 0 times; documents
without a source form a source of their own, the last in order; repeated rows are mixed
as documents of their own; an empty table gives an empty one; columns other than doc_id,
text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, text_of

#: Documents that one step pairs at once, and how often a source may be repeated.
BLOCK, REPEAT = 1024, 3


def targets(sizes: DataFrame) -> DataFrame:
    """Per source key: source_size and target. The table has one row per source, not per document.

    A target is min(3 * size, level * weight) with the level at which targets add up to all
    words; that is where resharing the excess by weight ends.
    """
    sources = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    every, by_key = Window.partitionBy(), Window.orderBy(F.col("skey").startswith("n"), "skey")
    weighed = sources.select("skey", "source_size", ((F.row_number().over(by_key) - 1) % 3 + 1).cast("double").alias("weight"))
    cap = F.lit(float(REPEAT)) * F.col("source_size")
    full = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    ranked = weighed.withColumns({"cap": cap, "words": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)}).withColumns(
        {"capped": F.coalesce(F.sum("cap").over(full), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(full), F.lit(0.0))}
    )
    # the level if all sources before this one stop at their caps; the first that stays below its cap gives it
    level = (F.col("words") - F.col("capped")) / (F.col("weights") - F.col("gone"))
    ranked = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    ranked = ranked.withColumn("found", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "skey", "level"))).over(every)["level"])
    return ranked.select("skey", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def chance(*of: Column | str, salt: int) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*of, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def _settle(units: Column, salt: int) -> Column:
    """Pairs the undecided units (doc_id, n, size, part) of an array: decided ones, and the one left over if any."""
    unit = "struct<doc_id:bigint,n:bigint,size:bigint,part:double>"
    decided = "array<struct<doc_id:bigint,n:bigint,up:int>>"
    none = F.lit(None).cast(unit)
    start = F.struct(none.alias("left"), F.array().cast(decided).alias("done"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]
        wa, wb = a["size"].cast("double"), b["size"].cast("double")
        up = F.least((1 - a["part"]) * wa, b["part"] * wb)  # words that can go from b to a
        down = F.least(a["part"] * wa, (1 - b["part"]) * wb)
        rise = chance(a["doc_id"], b["doc_id"], a["size"], b["size"], salt=salt) < down / (up + down)
        a_whole = F.when(rise, (1 - a["part"]) * wa <= b["part"] * wb).otherwise(a["part"] * wa <= (1 - b["part"]) * wb)
        b_whole = F.when(rise, (1 - a["part"]) * wa >= b["part"] * wb).otherwise(a["part"] * wa >= (1 - b["part"]) * wb)
        moved = lambda x, w, s: F.struct(x["doc_id"].alias("doc_id"), x["n"].alias("n"), x["size"].alias("size"), F.least(F.greatest(x["part"] + s / w, F.lit(0.0)), F.lit(1.0)).alias("part"))
        new_a = moved(a, wa, F.when(rise, up).otherwise(-down))
        new_b = moved(b, wb, F.when(rise, -up).otherwise(down))
        left = F.when(~a_whole, new_a).when(~b_whole, new_b).otherwise(none)
        whole = lambda x, up: F.array(F.struct(x["doc_id"].alias("doc_id"), x["n"].alias("n"), up.cast("int").alias("up")))
        no = F.array().cast(decided)
        done = F.concat(acc["done"], F.when(a_whole, whole(a, rise)).otherwise(no), F.when(b_whole, whole(b, ~rise)).otherwise(no))
        return F.when(a.isNull(), F.struct(b.alias("left"), acc["done"].alias("done"))).otherwise(F.struct(left.alias("left"), done.alias("done")))

    return F.aggregate(units, start, step)


def mix_sources(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row."""
    sizes = materialise(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    keyed = sizes.withColumn("skey", F.coalesce(F.concat(F.lit("k"), "source"), F.lit("n")))
    goal = targets(keyed)
    # Spark broadcasts the source table only while it is below its own limit; beyond that, hot sources are split by AQE
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # n tells rows of one doc_id apart; all of them get what the pivotal step says for their own row
    priced = keyed.join(goal, "skey").withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("part", F.col("copies") - F.col("whole"))
    priced = priced.withColumn("n", F.col("row"))
    priced = materialise(priced.drop("row", "copies"), "mix-priced")
    undecided = priced.where((F.col("size") > 0) & (F.col("part") > 0)).select("skey", F.struct("doc_id", "n", "size", "part").alias("u"))
    decided, level = [], 0
    while True:
        many = max((r["m"] for r in undecided.groupBy("skey").count().agg(F.max("count").alias("m")).collect()), default=None) or 0
        if many <= 1:
            break
        # of two levels the first spreads by hash; a source with one block pairs all it has
        blocks = -(-many // (BLOCK // 2)) if many > BLOCK else 1
        block = F.pmod(F.xxhash64("u.doc_id", "u.size", F.lit(level)), F.lit(blocks))
        grouped = undecided.groupBy("skey", block.alias("block")).agg(F.collect_list("u").alias("units"))
        ordered = F.array_sort(F.transform("units", lambda u: F.struct((-u["size"]).alias("less"), F.xxhash64(u["doc_id"], F.lit(level)).alias("h"), u.alias("u"))))
        settled = grouped.select("skey", _settle(F.transform(ordered, lambda x: x["u"]), level).alias("s"))
        settled = materialise(settled.select("skey", "s.left", "s.done"), f"mix-level{level}")
        decided.append(settled.select(F.explode("done").alias("d")).select("d.n", "d.up"))
        undecided = settled.where(F.col("left").isNotNull()).select("skey", F.col("left").alias("u"))
        level += 1
    last = undecided.select(F.col("u.n").alias("n"), (chance(F.col("u.doc_id"), salt=-1) < F.col("u.part")).cast("int").alias("up"))
    for d in decided:
        last = last.unionByName(d)
    return priced.join(last, "n", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        ((F.col("whole") + F.coalesce("up", F.lit(0))) * F.col("size")).cast("long").alias("taken"),
    )
