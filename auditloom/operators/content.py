"""Content checks: boilerplate, originality, templates, filler, dates, policy words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from . import closest, sharing, templates
from . import filler as repeating
from .graph import components, prepare

SIMILAR = 0.6
#: Words that site policies forbid; the first four need ASCII word borders.
BLACKLIST = (("adult", r"porn|xxx|nude|naked|sex\s*tube"), ("gambling", "gamble|casino|betting|lottery"), ("piracy", "hack|crack|pirate|torrent|warez"), ("drugs", "drug|marijuana|cocaine|heroin"), ("zh", "色情|赌博|毒品|暴力|盗版"))
#: Months as dates name them.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def ratios(main: DataFrame) -> DataFrame:
    """Per page: lengths of the text and its main part without white space, and their ratio in percent."""
    total, own = T.solid_length(F.col("text")), T.solid_length(F.col("main_text"))
    return main.select("site", "page_id", total.alias("total_length"), own.alias("main_length"), F.when(total > 0, T.rounded(own * 100 / total)).otherwise(0).cast("long").alias("ratio_percent"))


def ratio_status(main: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per site: pages whose main part is too small a share, thin subpages, and both checks' statuses. sizes: ratios() of main, where they are at hand."""
    first = Window.partitionBy("site").orderBy("page_id")
    df = (ratios(main) if sizes is None else sizes).withColumn("sub", F.row_number().over(first) > 1)
    low = (F.col("main_length") / F.greatest(F.col("total_length"), F.lit(1)) < 0.3) & (F.col("total_length") > 200)
    df = df.groupBy("site").agg(F.count_if(low).alias("n_low"), F.count_if("sub").alias("n_sub"), F.count_if(F.col("sub") & (F.col("main_length") < 300)).alias("n_thin"))
    thin = F.when(F.col("n_thin") == 0, "pass").when(F.col("n_thin") * 2 > F.col("n_sub"), "fail").otherwise("warn")
    return df.select("site", "n_low", F.when(F.col("n_low") > 0, "fail").otherwise("pass").alias("ratio_status"), "n_sub", "n_thin", thin.alias("depth_status"))


def findings(main: DataFrame, as_of: str) -> DataFrame:
    """site, finding, page_id, detail: the pages behind the counts: too small a main part (low_ratio), thin subpages, long pages without a recent date (stale)."""
    first = main.groupBy("site").agg(F.min("page_id").alias("home"))
    recent = freshness(main.select(F.col("page_id").alias("text_id"), "text"), as_of).select(F.col("text_id").alias("page_id"), "recent")
    df = ratios(main).join(main.select("page_id", F.length("text").alias("n")), "page_id").join(recent, "page_id").join(first, "site")
    size = F.col("main_length").cast("string")
    low = (F.col("main_length") / F.greatest(F.col("total_length"), F.lit(1)) < 0.3) & (F.col("total_length") > 200)
    tests = [("low_ratio", low, F.concat(F.col("ratio_percent").cast("string"), F.lit("% ("), size, F.lit(" chars)"))), ("thin", (F.col("page_id") != F.col("home")) & (F.col("main_length") < 300), F.concat(size, F.lit(" chars"))), ("stale", ~F.col("recent") & (F.col("n") > 200), F.lit(""))]
    rows = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(n).alias("finding"), d.alias("detail"))) for n, t, d in tests)))
    return df.select("site", "page_id", F.explode(rows).alias("f")).select("site", "f.finding", "page_id", "f.detail")


def filler(texts: DataFrame, key: str) -> DataFrame:
    """Counts of filler phrases, Chinese and English, per text."""
    t = F.coalesce("text", F.lit(""))
    return texts.select(key, F.regexp_count(t, F.lit(T.FILLER_ZH)).cast("long").alias("n_zh"), F.regexp_count(t, F.lit(T.FILLER_EN)).cast("long").alias("n_en"))


def repeats(texts: DataFrame, key: str) -> DataFrame:
    """Counts of units of 10 to 30 characters that stand four times or more in a row."""
    return texts.select(key, repeating.repeats(F.col("text")).alias("n_repeats"))


def _grams(main: DataFrame) -> DataFrame:
    """site, page_id, g: the distinct 4-grams of pages that have at least three grams."""
    # explode() of one row keeps the optimizer from putting the words' expression into each gram's
    once = lambda x: F.explode(F.array(x))
    own = main.select("site", "page_id", once(T.words(F.col("main_text"))).alias("own"))
    enough = own.where((F.size("own") == T.LEAST_GRAMS) | (F.size("own") >= T.LEAST_GRAMS + T.GRAM - 1))
    return enough.select("site", "page_id", once(F.array_distinct(T.grams("own"))).alias("g"))


def jaccard_pairs(main: DataFrame) -> DataFrame:
    """site, a, b, similarity for all pages of a site that share a 4-gram; there are as many as pairs that share something, but none is shuffled. Grams are told apart by 64 bits."""
    return sharing.sharing_pairs(_grams(main).select("site", "page_id", F.transform("g", lambda x: F.xxhash64(x)).alias("grams")))


def duplication(main: DataFrame) -> DataFrame:
    """Per site: the two pages most alike, their similarity, the originality score, and the check's status; grams are told apart by 64 bits."""
    sets = _grams(main).select("site", "page_id", F.transform("g", lambda x: F.xxhash64(x)).alias("grams"), F.sha2(F.array_join(F.array_sort("g"), "\n"), 256).alias("digest"))
    df = main.select("site").distinct().join(closest.closest_pairs(sets), "site", "left").withColumn("m", F.coalesce("similarity", F.lit(0.0)))
    score = F.greatest(F.lit(0), F.least(F.lit(100), T.rounded((1 - F.col("m")) * 100))).cast("long")
    return df.select("site", F.round("m", 6).alias("max_similarity"), score.alias("originality_score"), F.when(T.rounded(F.col("m") * 100) >= 60, "warn").otherwise("pass").alias("status"), F.col("a").alias("page_a"), F.col("b").alias("page_b"))


def _shapes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their skeletons, stored, since they are read several times; distinct skeletons of each site with the least page_id and the number of pages)."""
    pages = stored(texts.select("site", "page_id", T.skeleton(F.col("text")).alias("s")).where("s <> ''"), "skeletons")
    return pages, pages.groupBy("site", "s").agg(F.min("page_id").alias("shape"), F.count("*").alias("copies"))


def template_pairs(texts: DataFrame) -> DataFrame:
    """site, a, b, similarity of pages whose skeletons agree at SIMILAR of the longer one's places or more.

    Distinct skeletons are compared; pages take their skeleton's pairs.
    """
    pages, shapes = _shapes(texts)
    members = pages.join(shapes.select("site", "s", "shape"), ["site", "s"]).select("site", "shape", "page_id")
    left, right = members.select("site", F.col("shape").alias("a"), F.col("page_id").alias("p")), members.select("site", F.col("shape").alias("b"), F.col("page_id").alias("q"))
    apart = templates.compared(shapes, False).join(left, ["site", "a"]).join(right, ["site", "b"]).select("site", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.round(F.col("same") / F.col("longer"), 6).alias("similarity"))
    equal = left.join(right.withColumnRenamed("b", "a"), ["site", "a"]).where("p < q").select("site", F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("similarity"))
    return apart.unionByName(equal)


def template_clusters(texts: DataFrame) -> DataFrame:
    """Per site of three pages or more: the highest similarity, the largest cluster, and whether it is a template.

    Clusters are found among distinct skeletons; a page without a skeleton is a cluster of its own.
    """
    _, shapes = _shapes(texts)
    prepare(texts.sparkSession)
    shapes = shapes.checkpoint()
    pairs = templates.compared(shapes, True).checkpoint()
    found = components(pairs.select("a", "b"))
    clusters = shapes.join(found, shapes["shape"] == found["node"], "left").groupBy("site", F.coalesce("component", "shape").alias("c")).agg(F.sum("copies").alias("size"), F.max("copies").alias("equal"))
    sizes = clusters.groupBy("site").agg(F.max("size").alias("size"), F.max("equal").alias("equal"))
    best = pairs.groupBy("site").agg(F.max(F.round(F.col("same") / F.col("longer"), 6)).alias("m"))
    df = texts.groupBy("site").agg(F.count("*").alias("n")).where("n >= 3").join(sizes, "site", "left").join(best, "site", "left")
    df = df.withColumns({"m": F.when(F.col("equal") > 1, 1.0).otherwise(F.coalesce("m", F.lit(0.0))), "size": F.coalesce("size", F.lit(1))})
    return df.select("site", F.col("m").alias("max_similarity"), F.col("size").cast("long").alias("cluster_size"), ((F.col("m") > SIMILAR) & (F.col("size") >= 3)).alias("is_template"))


def dates(texts: DataFrame, as_of: str) -> DataFrame:
    """text_id, date: valid dates in texts, after 2020-01-01 and not after as_of."""
    t = F.col("text")
    iso = r"([0-9]{4})[年/.-]([0-9]{1,2})[月/.-]([0-9]{1,2})"
    mdy = rf"(?i)({MONTHS})\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})"
    dmy = r"(?i)([0-9]{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[A-Za-z0-9_]*\s+([0-9]{4})"
    my = rf"(?i)({MONTHS})\s+([0-9]{{4}})"
    month = lambda x: F.lpad(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(x, 1, 3))) + 2) / 3).cast("int").cast("string"), 2, "0")
    two = lambda x: F.lpad(x, 2, "0")
    # a text is searched once for each form; year, month and day are read from what was found
    read = lambda pattern, of: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda d: F.concat_ws("-", *of(lambda k: F.regexp_extract(d, pattern, k))))
    all_ = F.concat(
        read(iso, lambda g: (g(1), two(g(2)), two(g(3)))),
        read(mdy, lambda g: (g(3), month(g(1)), two(g(2)))),
        read(dmy, lambda g: (g(3), month(g(2)), two(g(1)))),
        read(my, lambda g: (g(2), month(g(1)), F.lit("01"))),
    )
    found = texts.select("text_id", F.explode(all_).alias("d")).select("text_id", F.try_to_date("d", "yyyy-MM-dd").alias("date"))
    return found.where((F.col("date") > F.lit("2020-01-01").cast("date")) & (F.col("date") <= F.lit(as_of).cast("date"))).distinct()


def freshness(texts: DataFrame, as_of: str) -> DataFrame:
    """Per text: its latest date, and whether that lies within 180 days before as_of."""
    best = dates(texts, as_of).groupBy("text_id").agg(F.max("date").alias("latest"))
    df = texts.select("text_id").join(best, "text_id", "left")
    recent = F.coalesce(F.datediff(F.lit(as_of).cast("date"), "latest") <= 180, F.lit(False))
    return df.select("text_id", F.col("latest").cast("string").alias("latest"), recent.alias("recent"))


def policy_hits(texts: DataFrame) -> DataFrame:
    """site, page_id, rule, word, long_page: the first match of each rule in each page."""

    def first(rule: str, words: str) -> Column:
        pattern = f"({words})" if rule == "zh" else rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"
        return F.struct(F.lit(rule).alias("rule"), F.lower(F.regexp_extract("text", pattern, 1)).alias("word"))

    found = F.filter(F.array(*(first(*r) for r in BLACKLIST)), lambda x: x["word"] != "")
    long_page = T.solid_length(F.col("text")) > 200
    return texts.select("site", "page_id", long_page.alias("long_page"), F.explode(found).alias("f")).select("site", "page_id", "f.rule", "f.word", "long_page")


def policy_verdict(texts: DataFrame) -> DataFrame:
    """Per site: hits, and pass without any, warn if all are on long pages, else fail."""
    hits = policy_hits(texts).groupBy("site").agg(F.count("*").alias("n"), F.bool_and("long_page").alias("mild"))
    df = texts.select("site").distinct().join(hits, "site", "left")
    return df.select("site", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"), F.when(F.col("n").isNull(), "pass").when(F.col("mild"), "warn").otherwise("fail").alias("status"))
