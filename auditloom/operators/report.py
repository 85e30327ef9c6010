"""Check items of a site, their categories, and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..sources.scratch import stored
from . import boilerplate, content, crawl, filler, timing

#: Bucket of each check: H site-wide, C content, U use, L landing page.
BUCKETS = {"site_scale": "H", "about": "H", "privacy": "H", "contact": "H", "terms": "H", "policy_keywords": "H", "ai_compliance": "H", "content_ratio": "C", "subpage_depth": "C", "filler": "C", "duplication": "C", "template": "C", "game_description": "C", "iframe_quality": "C", "video_description": "C", "reference_entry": "C", "freshness": "C", "home_content": "L", "h1": "L", "internal_links": "L", "viewport": "L", "heading_order": "U", "navigation": "U"}


#: Types of sites whose texts are held to content rules; the others have items of their own.
OTHER_TYPES = ("game", "video", "reference")


def check_items(pages: DataFrame, compliance: DataFrame | None = None, types: DataFrame | None = None, as_of: str = "2100-01-01", phases: timing.Phases | None = None, main: DataFrame | None = None) -> DataFrame:
    """site, item, bucket, status; compliance (site, status, mean_compliance) adds its own item where given.

    types: site, type; sites without a type are content sites. Markup is read once for all
    that a page says by itself, once more for its links; what a site says is one row, and rows of sites become items
    only at the end. A mean compliance of 7 or more softens a failed word check.
    phases measures facts and main texts, which are written on the way. main: main_content() of the pages' texts, where it is at hand.
    """
    html = F.col("html")
    levels = crawl.heading_levels(html)
    # three narrow tables for all that follows: what each page's markup says by itself, its links, and main texts
    own = (F.col("url"), T.visible(html).alias("text"), crawl.h1_count(html).alias("h1_count"), crawl.nav_text(html).alias("nav_text"), crawl.skips(levels, 1).alias("heading_skip"))
    keep = phases.stored if phases else stored
    facts = keep(crawl.page_signals(pages, *own).drop("iframe_srcs", "list_items", "game_links"), "facts")
    texts = facts.select("site", "page_id", "url", "text")
    all_links = stored(crawl.page_links(pages), "links")
    main = keep(boilerplate.main_content(texts), "main") if main is None else main
    lengths = stored(content.ratios(main), "lengths")
    c = F.col
    fillers = F.regexp_count("text", F.lit(T.FILLER_ZH)) + F.regexp_count("text", F.lit(T.FILLER_EN)) + filler.repeats(c("text"))
    home = F.min_by(F.struct("h1_count", "nav_text", "has_viewport", "heading_skip"), "page_id")
    embeds = (c("iframes") > 0) | (c("canvases") > 0)
    first = Window.partitionBy("site").orderBy("page_id")
    sites = facts.withColumn("fillers", fillers).drop("text").withColumn("sub", F.row_number().over(first) > 1).groupBy("site").agg(
        F.count("*").alias("n"),
        F.sum("fillers").alias("fillers"),
        home.alias("home"),
        F.min("page_id").alias("page_id"),
        F.count_if(c("sub") & embeds).alias("n_embeds"),
        F.count_if(c("sub") & embeds & (c("text_length") < 100)).alias("thin_embeds"),
        F.count_if(c("sub") & (c("text_length") < 100)).alias("thin_entries"),
        F.count_if(c("sub") & (c("text_length") < 50)).alias("thin_videos"),
        F.sum("iframes").alias("iframes"),
    )
    size = lengths.groupBy("site").agg(F.min_by("main_length", "page_id").alias("home_length"))
    links = sites.select("site", "page_id").join(crawl.internal_links(pages, all_links), ["site", "page_id"]).select("site", "n_same_site")
    named = lambda df, name: df.select("site", F.col("status").alias(name))
    required = crawl.required_pages(pages, pages.select("site", "page_id", "url"), all_links).groupBy("site").agg(*(F.bool_or((F.col("required") == n) & (F.col("found_by") != "missing")).alias(n) for n, _, _ in crawl.REQUIRED_PAGES))
    recent = texts.select("site", c("page_id").alias("text_id")).join(content.freshness(texts.select(c("page_id").alias("text_id"), "text"), as_of), "text_id").groupBy("site").agg(F.bool_or("recent").alias("recent"))
    frames = [named(crawl.site_pages(pages, all_links), "site_scale"), named(content.policy_verdict(texts), "policy"), named(content.duplication(main), "dup"), content.ratio_status(main, lengths), size, required, links, recent]
    if compliance is not None:
        frames.append(compliance.select("site", F.col("status").alias("comply"), "mean_compliance"))
    if types is not None:
        frames.append(types.select("site", "type"))
    wide = sites
    for f in frames:
        wide = wide.join(f, "site", "left")
    kind = F.coalesce("type", F.lit("content")) if types is not None else F.lit("content")
    warn = lambda ok: F.when(ok, "pass").otherwise("warn")
    of = lambda name, x: F.when(kind == name, x)
    plain = lambda x: F.when(~kind.isin(*OTHER_TYPES), x)
    several = lambda x: F.when(c("n") > 1, x)
    policy = c("policy")
    if compliance is not None:
        policy = F.when((c("policy") == "fail") & (c("mean_compliance") >= 7), "warn").otherwise(c("policy"))
    status = {
        "site_scale": c("site_scale"),
        **{n: warn(c(n)) for n, _, _ in crawl.REQUIRED_PAGES},
        "policy_keywords": policy,
        "content_ratio": plain(c("ratio_status")),
        "subpage_depth": plain(several(c("depth_status"))),
        "filler": plain(warn(c("fillers") <= 3 * c("n"))),
        "home_content": plain(F.when(c("home_length") >= 500, "pass").otherwise("fail")),
        "game_description": of("game", F.when(c("n_embeds") > 0, warn(c("thin_embeds") * 2 <= c("n_embeds")))),
        "iframe_quality": of("game", F.when(c("iframes") > 0, warn(c("iframes") <= 20))),
        "video_description": of("video", several(warn(c("thin_videos") * 2 <= c("n") - 1))),
        "reference_entry": of("reference", several(warn(c("thin_entries") * 2 <= c("n") - 1))),
        "freshness": warn(F.coalesce("recent", F.lit(False))),
        "duplication": c("dup"),
        "template": F.when(c("n") >= 3, "pass"),
        "h1": warn(c("home.h1_count") == 1),
        "internal_links": warn(F.coalesce("n_same_site", F.lit(0)) >= 5),
        "viewport": warn(c("home.has_viewport")),
        "heading_order": warn(~c("home.heading_skip")),
        "navigation": warn(c("home.nav_text") != ""),
    }
    if compliance is not None:
        status["ai_compliance"] = c("comply")
    items = [F.struct(F.lit(n).alias("item"), F.lit(BUCKETS[n]).alias("bucket"), x.alias("status")) for n, x in status.items()]
    return wide.select("site", F.explode(F.array(*items)).alias("i")).select("site", "i.item", "i.bucket", "i.status").where("status is not null")


def category_scores(items: DataFrame) -> DataFrame:
    """Per site and bucket: points of its checks, and the most there could be."""
    return items.groupBy("site", "bucket").agg(F.sum(S.status_points(F.col("status"))).alias("score"), (F.count("*") * 100).alias("max_score"))


def _tallied(items: DataFrame) -> DataFrame:
    """Per site, in one aggregate: checks by status, hard status, qualities."""
    n = lambda s: F.count_if(F.col("status") == s)
    hard, points = F.col("bucket") == "H", S.status_points(F.col("status"))
    return items.groupBy("site").agg(
        n("pass").alias("passed"),
        n("warn").alias("warned"),
        n("fail").alias("failed"),
        n("skip").alias("skipped"),
        F.when(F.bool_or(hard & (F.col("status") == "fail")), "fail").when(F.bool_or(hard & (F.col("status") == "warn")), "warn").otherwise("ready").alias("hard_status"),
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(F.col("bucket").isin("H", "C", "U"), points)), F.lit(100.0)).alias("site_quality"),
        F.coalesce(F.avg(F.when(F.col("bucket") == "L", points)), F.lit(100.0)).alias("home_quality"),
    )


def status_counts(items: DataFrame) -> DataFrame:
    """Per site: checks by status, hard status, warning ratio and penalty, and the share that passed."""
    ratio = F.col("warned") / F.col("n")
    return _tallied(items).select("site", "passed", "warned", "failed", "skipped", "hard_status", F.round(ratio, 6).alias("warning_ratio"), F.when(ratio > 0.15, T.rounded((ratio - 0.15) * 100)).otherwise(0).cast("long").alias("penalty"), T.rounded(F.col("passed") * 100 / F.col("n")).alias("pass_percent"))


def site_report(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Per site: site and home quality, value, cap, composite and soft score, and hard status. Numbers are rounded last."""
    df = _tallied(items).join(scores, "site", "left")
    site, home, cap = F.col("site_quality"), F.col("home_quality"), F.coalesce("cap", F.lit(100))
    value = F.coalesce("vot", T.rounded((site + home) / 2).cast("double"))
    soft = T.rounded(value * 0.6 + (site + home) / 2 * 0.4)
    return df.select("site", T.rounded(site).alias("site_quality"), T.rounded(home).alias("home_quality"), T.rounded(value).alias("vot"), cap.cast("long").alias("cap"), S.composite(F.col("vot"), site, home, cap).alias("composite"), soft.alias("soft_score"), "hard_status", "passed", "warned", "failed", F.round(F.col("warned") / F.col("n"), 6).alias("warning_ratio"))


def composites(rows: DataFrame) -> DataFrame:
    """case_id and composite from vot, site, home, least compliance and mean relevance."""
    cap = F.when(F.col("least_compliance") < 6, 50).when(F.col("mean_relevance") < 6, 60).otherwise(100)
    return rows.select(F.col("case_id").cast("long").alias("case_id"), S.composite(F.col("vot"), F.col("site_quality"), F.col("home_quality"), cap).alias("composite"))


def approval(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """A rule-based estimate, 0 to 100, of a site's chance to be accepted, how sure it is, and the first five of its reasons."""
    c = F.col
    rules = [
        [(c("composite") >= 75, 25, "composite_high"), (c("composite") >= 50, 10, "composite_mid"), (F.lit(True), -15, "composite_low")],
        [(c("hard_status") == "ready", 15, "hard_ready"), (c("hard_status") == "fail", -25, "hard_fail"), (F.lit(True), -10, "hard_warn")],
        [(c("ai_score") <= 0, 0, None), (c("ai_score") >= 60, 10, "ai_high"), (c("ai_score") >= 40, 5, None), (F.lit(True), -10, "ai_low")],
        [(c("least_originality") >= 6, 5, None), (c("least_originality") < 4, -10, "originality_low")],
        [(c("low_ratio") >= 0.5, -10, "many_low"), (c("low_ratio") < 0.2, 5, None)],
    ]

    def picked(rule: list, at: int, default: Column) -> Column:
        out = F.when(rule[0][0], F.lit(rule[0][at]))
        for r in rule[1:]:
            out = out.when(r[0], F.lit(r[at]))
        return F.coalesce(out, default)

    points = F.lit(50)
    for rule in rules:
        points += picked(rule, 1, F.lit(0))
    reasons = F.slice(F.array_compact(F.array(*(picked(r, 2, F.lit(None).cast("string")) for r in rules))), 1, 5)
    trust = F.when(c("n_pages") >= 10, "high").when(c("n_pages") >= 5, "medium").otherwise("low")
    return rows.select(key, F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("long").alias("probability"), trust.alias("confidence"), F.array_join(reasons, ", ").alias("factors"))
