"""One record per page of a report, and reports grouped from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages
from ..functions import scores as S
from ..functions import urls

#: Page types in the order of reports.
REPORT_ORDER = ("homepage", "listing", "reference_listing", "content", "game_detail", "video_detail", "reference_detail", "required", "utility", "unknown")
THIN = 300


def page_details(pages: DataFrame, ratios: DataFrame, signals: DataFrame, meta: DataFrame, types: DataFrame, scored: DataFrame) -> DataFrame:
    """A record per page: sizes, content status, issues, embed, score, relevance, and the status shown.

    Only content sites' pages that have something to say are held to a least length. A
    reply that isn't pass goes before a content status of pass.
    """
    c = F.col
    replies = scored.select("page_id", *S.DIMENSIONS)
    df = pages.select("site", "page_id", urls.page_type(urls.path(c("url"))).alias("page_type")).join(ratios.select("page_id", "total_length", "main_length", "ratio_percent"), "page_id")
    df = df.join(signals.select("page_id", "iframes", "canvases", "videos"), "page_id").join(meta.select("page_id", "title", "lang"), "page_id").join(types.select("site", "type"), "site").join(replies, "page_id", "left")
    there = c("value").isNotNull()
    mean = S.geometric([c(d) for d in S.DIMENSIONS])
    serves = c("page_type").isin("required", "utility")
    df = df.withColumns({
        "embed": F.when((c("iframes") > 0) | (c("canvases") > 0), "game").when(c("videos") > 0, "video").otherwise("none"),
        "ai_status": F.when(there, F.when(mean >= 7, "pass").when(mean >= 4, "warn").otherwise("fail")),
        "relevance_label": F.when(there, F.when(c("relevance") >= 7, "relevant").when(c("relevance") >= 4, "tangential").otherwise("off-topic")),
        "content_status": F.when((c("type") == "content") & ~serves & (c("main_length") < THIN), "warn").otherwise("pass"),
    })
    unsure = F.when((c("embed") == "game") & (c("page_type") == "game_detail"), "game can't be verified").when((c("embed") == "video") & (c("page_type") == "video_detail"), "video can't be verified")
    thin = F.when(c("content_status") == "warn", F.concat(F.lit("Thin content ("), c("main_length").cast("string"), F.lit(" chars)")))
    shown = F.when((c("content_status") == "pass") & (c("ai_status") != "pass"), c("ai_status")).otherwise(c("content_status"))
    return df.select(
        "site",
        "page_id",
        "title",
        "page_type",
        "lang",
        c("total_length").alias("total_chars"),
        c("main_length").alias("content_chars"),
        c("ratio_percent").alias("content_ratio"),
        "content_status",
        F.concat_ws("; ", unsure, thin).alias("issues"),
        "embed",
        "ai_status",
        "relevance_label",
        F.when(c("ai_status") == "fail", 0).when(c("ai_status") == "warn", 70).otherwise(100).cast("long").alias("score"),
        shown.alias("display_status"),
    )


def is_problem(grouped: bool = False):
    """Whether a record shows a problem; in grouped reports, pages that only serve a function never do."""
    c = F.col
    found = (c("content_status") != "pass") | (c("issues") != "") | F.coalesce(c("ai_status") != "pass", F.lit(False))
    return found & ~c("page_type").isin("required", "utility") if grouped else found


def pages_by_type(details: DataFrame) -> DataFrame:
    """site, page_type, position in the report, and pages with and without problems."""
    order = F.array_position(F.array(*(F.lit(t) for t in REPORT_ORDER)), F.col("page_type"))
    out = details.groupBy("site", "page_type").agg(F.count_if(is_problem(True)).alias("n_problems"), F.count("*").alias("n"))
    return out.select("site", "page_type", order.cast("long").alias("position"), "n_problems", (F.col("n") - F.col("n_problems")).alias("n_ok"))


def markdown(report: DataFrame, groups: DataFrame) -> DataFrame:
    """site, markdown: a short report of a site, page types in the order of reports."""
    line = F.concat(F.lit("- "), "page_type", F.lit(": "), F.col("n_problems").cast("string"), F.lit(" with problems, "), F.col("n_ok").cast("string"), F.lit(" without"))
    lines = groups.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("g"))
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("-"))
    head = F.concat(F.lit("# "), "site", F.lit("\n\nScore: "), text("composite"), F.lit("/100. Requirements: "), "hard_status", F.lit(". Checks: "), text("passed"), F.lit(" passed, "), text("warned"), F.lit(" warned, "), text("failed"), F.lit(" failed.\n\n"))
    return report.join(lines, "site").select("site", F.concat(head, F.array_join(F.transform("g", lambda x: x["line"]), "\n")).alias("markdown"))


#: Buckets in the order of reports.
BUCKETS = ("H", "C", "L", "U")


def report_lines(report: DataFrame, items: DataFrame, groups: DataFrame, details: DataFrame, lang: str) -> DataFrame:
    """site, part, ordinal, line: a site's whole report as lines in order, in a language; a line a row, so that no site's report is one value.

    Parts: 0 to 2 the head, 10 and on the buckets of checks, 20 and 21 the types of pages, 30 and 31 pages with problems.
    """
    c, lit = F.col, F.lit
    word = lambda x: x.cast("string")
    given = lambda **v: F.create_map(*(y for n, x in v.items() for y in (lit(n), word(x)))) if v else F.create_map().cast("map<string,string>")
    row = lambda df, part, ordinal, key, params: df.select("site", part.cast("int").alias("part"), word(ordinal).alias("ordinal"), key.alias("key"), params.alias("params"))
    place = F.array_position(F.array(*(lit(b) for b in BUCKETS)), c("bucket")) * 2 + 8
    bad = details.where(is_problem())
    rows = [
        row(report, lit(0), lit(""), lit("head"), given(site=c("site"))),
        row(report, lit(1), lit(""), lit("score"), given(composite=c("composite"), soft=c("soft_score"), hard=c("hard_status"))),
        row(report, lit(2), lit(""), lit("counts"), given(passed=c("passed"), warned=c("warned"), failed=c("failed"))),
        row(items.select("site", "bucket").distinct(), place, lit(""), F.concat(lit("bucket."), c("bucket")), given()),
        row(items, place + 1, c("item"), F.concat(lit("item."), c("status")), given(item=c("item"))),
        row(report, lit(20), lit(""), lit("pages"), given()),
        row(groups, lit(21), F.lpad(word(c("position")), 4, "0"), lit("group"), given(type=c("page_type"), bad=c("n_problems"), ok=c("n_ok"))),
        row(bad.select("site").distinct(), lit(30), lit(""), lit("problems"), given()),
        row(bad, lit(31), F.lpad(word(c("page_id")), 20, "0"), lit("problem"), given(page=c("page_id"), status=c("display_status"), issues=c("issues"))),
    ]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    told = F.broadcast(messages.texts(report.sparkSession, lang))  # a few dozen rows
    return both.join(told, "key").select("site", "part", "ordinal", messages.filled(c("text"), c("params")).alias("line"))


def approval_inputs(report: DataFrame, stats: DataFrame, ai_scores: DataFrame, details: DataFrame) -> DataFrame:
    """Per site what an estimate of its chances needs: scores, least originality, largest share of low scores, pages."""
    n = details.groupBy("site").agg(F.count("*").alias("n_pages"), F.bool_or(F.col("ai_status").isNotNull()).alias("analysed"))
    low = stats.groupBy("site").agg(F.max("n_low").alias("n_low"), F.min(F.when(F.col("dimension") == "originality", F.col("least"))).alias("least"))
    df = report.select("site", "composite", "hard_status").join(n, "site").join(low, "site", "left").join(ai_scores.select("site", "ai_score"), "site", "left")
    known = lambda x: F.when(F.col("analysed"), x)
    return df.select("site", "composite", "hard_status", F.coalesce(known(F.col("ai_score")), F.lit(0)).alias("ai_score"), known(F.col("least")).alias("least_originality"), known(F.col("n_low") / F.col("n_pages")).alias("low_ratio"), "n_pages")


def with_replies(details: DataFrame, parsed: DataFrame) -> DataFrame:
    """Page records with what the model said of the page: scores, reasons, assessment and suggestions; null (no suggestions) where it said nothing. parsed: parse_replies() rows by page_id."""
    told = [*S.DIMENSIONS, *(f"{d}_reason" for d in S.DIMENSIONS), "assessment", "suggestions"]
    return details.join(parsed.select("page_id", *told), "page_id", "left").select(*details.columns, *told[:-1], F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def candidates(links: DataFrame, crawled: DataFrame, most: int) -> DataFrame:
    """site, norm_url, rank: linked content addresses that weren't crawled, the first `most` of a site in the order found (by page, then place)."""
    inside = (urls.site(F.col("href")) == F.col("site")) & urls.is_content(F.col("href")) & ~(urls.path(F.col("href")).isin("/", "") & F.col("href").contains("?"))
    own = links.where(inside).groupBy("site", urls.normalised(F.col("href")).alias("norm_url")).agg(F.min(F.struct("page_id", "pos")).alias("found"))
    fresh = own.join(crawled.select("site", urls.normalised(F.col("url")).alias("norm_url")), ["site", "norm_url"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("found", "norm_url"))).where(F.col("rank") <= most).select("site", "norm_url", "rank")
