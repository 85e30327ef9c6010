"""Registered queries over a crawl, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import boilerplate, content, crawl, details, frontier, replies, report, resources, sampling, scorer, site_type, styles, timing, topics
from ..sources import reports, scratch, tables
from . import derived as D
from . import examples as E
from .sql import oracle_sql

__all__ = ["oracle_sql", "queries"]

BUDGET, MOST, CANDIDATES = 5, 8, 50


def _pages(s: SparkSession, d: str) -> DataFrame:
    return tables.pages(s, d)


def _texts(s: SparkSession, d: str) -> DataFrame:
    return crawl.page_text(_pages(s, d))


def _main(s: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_content(_texts(s, d))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return replies.stand_in_scores(_pages(s, d), tables.table(s, d, "labels"))


def _numbered(s: SparkSession, values: list, names: str) -> DataFrame:
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
    return tables.inline(s, rows, names)


def _derived(s: SparkSession, d: str, text: str) -> DataFrame:
    """Rows that a text of derived.py makes of the crawl."""
    with_ = {"pages": _pages(s, d)} if "{pages}" in text else {"links": crawl.page_links(_pages(s, d)).select("site", "href")}
    return s.sql(text, **with_)


def _beside(s: SparkSession, d: str, text: str, fixed: DataFrame) -> DataFrame:
    """The derived rows and fixed ones."""
    made = _derived(s, d, text)
    return made.unionByName(fixed.select(*(F.col(c).cast(made.schema[c].dataType).alias(c) for c in made.columns)))


def _types(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    return site_type.site_type(site_type.site_features(crawl.page_signals(p), crawl.page_meta(p)))


def _items(s: SparkSession, d: str) -> DataFrame:
    return report.check_items(_pages(s, d), replies.compliance_item(_scored(s, d)), _types(s, d), E.AS_OF)


def _classes(s: SparkSession, d: str) -> DataFrame:
    own = _pages(s, d).select("url")
    fixed = _numbered(s, E.URLS, "ordinal int, p string").select(F.concat(F.lit("https://fixed.example"), "p").alias("url"))
    return own.unionByName(fixed).distinct().select("url", urls.page_type(urls.path(F.col("url"))).alias("type"))


def _report(s: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    scores, types = replies.site_scores(_scored(s, d)).select("site", "vot", "cap"), _types(s, d).select("site", "n_pages", "type")
    return report.site_report(_items(s, d) if items is None else items, scores).join(types, "site")


def _phases(s: SparkSession, d: str) -> DataFrame:
    """The phases of the check items and the rows of each; how long each took isn't the same twice."""
    phases = timing.Phases()
    phases.stored(report.check_items(_pages(s, d), replies.compliance_item(_scored(s, d)), _types(s, d), E.AS_OF, phases), "items")
    return phases.report(s).select("phase", "position", "n_rows")


def _saved(s: SparkSession, d: str) -> DataFrame:
    """Reports written one file a site, read again and scored again. Main texts and types, which items and pages both need, are worked out once."""
    p, main, known = _pages(s, d), scratch.stored(_main(s, d), "main"), scratch.stored(_types(s, d), "types")
    scores, types = replies.site_scores(_scored(s, d)).select("site", "vot", "cap"), known.select("site", "n_pages", "type")
    items = report.check_items(p, replies.compliance_item(_scored(s, d)), known, E.AS_OF, main=main)
    pages = details.page_details(p, content.ratios(main), crawl.page_signals(p), crawl.page_meta(p), known, _scored(s, d))
    folder = scratch.scratch(s, "site-reports")
    reports.write_site_reports(reports.rows_of(types.join(scores, "site", "left").select("site", "vot", "cap", "n_pages", "type"), items, pages), folder, "audit")
    found, _ = reports.read_site_reports(s, folder)
    heads = reports.saved_heads(found)
    return report.site_report(reports.saved_items(found), heads.select("site", "vot", "cap")).join(heads.select("site", "n_pages", "type"), "site")


def _cases(s: SparkSession, d: str) -> DataFrame:
    """The crawl, and a site of pages that reach every branch."""
    rows = _numbered(s, E.PAGES, "page_id int, path string, html string")
    fixed = rows.select(F.lit("cases.example").alias("site"), (F.col("page_id") + E.CASES).alias("page_id"), F.concat(F.lit("https://cases.example"), "path").alias("url"), "html")
    return _pages(s, d).unionByName(fixed)


def _topics(s: SparkSession, d: str) -> DataFrame:
    return topics.home_topics(crawl.page_meta(_pages(s, d)))


def _prompts(s: SparkSession, d: str) -> DataFrame:
    return topics.prompts(_pages(s, d), _topics(s, d), E.AS_OF)


def _scored_replies(s: SparkSession, d: str) -> DataFrame:
    """Scores of the rehearsed replies to all pages; without a reply there are none."""
    got = scorer.replies(_prompts(s, d), scorer.Rehearsal(), wait=0.0)
    told = crawl.page_meta(_pages(s, d)).select("page_id", "lang")
    return replies.parse_replies(got.join(told, "page_id").select(F.col("page_id").alias("reply_id"), "lang", F.coalesce("response", F.lit("")).alias("response"))).select("reply_id", *replies.S.DIMENSIONS, "status")


def _topic_cases(s: SparkSession, d: str) -> DataFrame:
    rows = _numbered(s, E.METAS, "page_id int, site string, title string, description string, og_description string, h1_text string, nav_text string")
    return topics.home_topics(crawl.page_meta(_pages(s, d)).select("page_id", "site", "title", "description", "og_description", "h1_text", "nav_text").unionByName(rows.withColumn("page_id", F.col("page_id").cast("long"))))


def _details(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    return details.page_details(p, content.ratios(_main(s, d)), crawl.page_signals(p), crawl.page_meta(p), _types(s, d), _scored(s, d))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Whole reports as lines, in both languages."""
    own, items = scratch.stored(_details(s, d), "details"), scratch.stored(_items(s, d), "items")
    parts = scratch.stored(_report(s, d, items), "report"), items, details.pages_by_type(own), own
    return details.report_lines(*parts, "en").withColumn("lang", F.lit("en")).unionByName(details.report_lines(*parts, "zh").withColumn("lang", F.lit("zh")))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return replies.parse_replies(_beside(s, d, D.REPLIES, _numbered(s, E.REPLIES, "reply_id int, lang string, response string")))


def _approved(s: SparkSession, d: str) -> DataFrame:
    scored = _scored(s, d)
    return report.approval(details.approval_inputs(_report(s, d), replies.dimension_stats(scored), replies.site_scores(scored), _details(s, d)), "site")


def _resources(s: SparkSession, d: str) -> DataFrame:
    sites = tables.inline(s, [*((r[0],) for r in E.RESOURCES), ("e.example",)], "site string").unionByName(_pages(s, d).select("site"))
    fixed = tables.inline(s, E.RESOURCES, "site string, robots_ok boolean, robots_txt string, sitemap_ok boolean, ads_ok boolean")
    return resources.resource_items(sites, _beside(s, d, D.RESOURCES, fixed))


def _files(s: SparkSession, d: str) -> DataFrame:
    """sitemap, xml of files: those of the crawl, at most D.FILE addresses each, and fixed ones."""
    lines = _derived(s, d, D.SITEMAP_LINES).groupBy("sitemap", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spot", "line"))), lambda x: x["line"]), "").alias("body"))
    own = lines.select("sitemap", F.concat(F.lit("<"), "kind", F.lit(">"), "body", F.lit("</"), "kind", F.lit(">")).alias("xml"))
    return own.unionByName(tables.inline(s, E.SITEMAPS, "sitemap string, xml string"))


def _robots(s: SparkSession, d: str) -> DataFrame:
    own = _derived(s, d, D.RESOURCES).where("robots_ok").select("site", "robots_txt")
    return crawl.robots_sitemaps(own.unionByName(tables.inline(s, E.ROBOTS, "site string, robots_txt string")))


def _expanded(s: SparkSession, d: str) -> DataFrame:
    return crawl.sitemap_urls(_robots(s, d), _files(s, d))


def _sources(s: SparkSession, d: str) -> DataFrame:
    default = _derived(s, d, D.RESOURCES).where("sitemap_ok").select("site", F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("sitemap"))
    default = default.unionByName(tables.inline(s, [("a.example", "https://a.example/t.xml")], "site string, sitemap string"))
    return resources.sitemap_sources(crawl.sitemap_urls(default, _files(s, d)), _expanded(s, d))


def _responses(s: SparkSession, d: str) -> DataFrame:
    return _beside(s, d, D.RESPONSES, tables.inline(s, E.RESPONSES, "site string, url string, status int"))


def _home_links(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    home = p.groupBy("site").agg(F.min("page_id").alias("page_id")).join(crawl.internal_links(p), ["site", "page_id"]).select("site", "n_links", "n_same_site")
    return home.unionByName(tables.inline(s, E.HOME_LINKS, "site string, n_links int, n_same_site int"))


def _suggestions(s: SparkSession, d: str) -> DataFrame:
    fixed = _numbered(s, E.SUGGESTIONS, "ordinal int, suggestion string").withColumn("site", F.lit("fixed.example"))
    return sampling.merged_suggestions(_beside(s, d, D.SUGGESTIONS, fixed), _derived(s, d, D.ACTIONS))


def _paths(s: SparkSession, d: str) -> DataFrame:
    own = _pages(s, d).select("site", (F.col("page_id") + 1000).alias("ordinal"), urls.path(F.col("url")).alias("path"))
    return own.unionByName(_numbered(s, E.PATHS, "ordinal int, path string").withColumn("site", F.lit("fixed.example")))


def _dated(s: SparkSession, d: str) -> DataFrame:
    own = tables.table(s, d, "documents").select((F.col("doc_id") + 1000).alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    return content.freshness(own.unionByName(_numbered(s, E.TEXTS, "text_id int, text string")), E.AS_OF)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "url_normalize_dedup": lambda s, d: crawl.distinct_pages(_pages(s, d)),
        "url_classify": _classes,
        "content_url_filter": lambda s, d: crawl.content_urls(_pages(s, d)),
        "url_freshness": lambda s, d: sampling.by_freshness(_paths(s, d)),
        "stratified_sample": lambda s, d: sampling.sample_by_type(_pages(s, d), BUDGET, MOST),
        "page_text": lambda s, d: _texts(s, d).select("site", "page_id", "text"),
        "page_meta": lambda s, d: crawl.page_meta(_pages(s, d)),
        "page_links_internal": lambda s, d: crawl.internal_links(_pages(s, d)),
        "page_signals": lambda s, d: crawl.page_signals(_pages(s, d)).drop("iframe_srcs"),
        "signal_cases": lambda s, d: crawl.page_signals(_cases(s, d)).withColumn("sources", F.array_join("iframe_srcs", " ")).drop("iframe_srcs"),
        "meta_cases": lambda s, d: crawl.page_meta(_cases(s, d)).select("site", "page_id", "title", "description", "og_description", "lang", "h1_text"),
        "link_cases": lambda s, d: crawl.page_links(_cases(s, d)).select("site", "page_id", "pos", "href", "anchor_text"),
        "page_styles": lambda s, d: styles.page_styles(_cases(s, d)),
        "heading_skip": lambda s, d: crawl.headings(_pages(s, d)),
        "required_pages": lambda s, d: crawl.required_pages(_pages(s, d), _pages(s, d).select("site", "page_id", "url")),
        "site_url_order": lambda s, d: crawl.site_urls(_pages(s, d), _pages(s, d).select("site", "page_id", "url")),
        "crawl_depth": lambda s, d: frontier.depths(_derived(s, d, D.CHAINED)),
        "crawl_reach": lambda s, d: frontier.reach(frontier.depths(_derived(s, d, D.CHAINED))),
        "main_content": lambda s, d: _main(s, d).select("site", "page_id", "main_text"),
        "content_ratio_depth": lambda s, d: content.ratio_status(_main(s, d)),
        "content_ratio_pages": lambda s, d: content.ratios(_main(s, d)),
        "filler_scan": lambda s, d: content.filler(tables.table(s, d, "documents"), "doc_id"),
        "filler_repeats": lambda s, d: content.repeats(tables.table(s, d, "documents"), "doc_id"),
        "ngram_jaccard_pairs": lambda s, d: content.jaccard_pairs(_main(s, d)),
        "duplication_score": lambda s, d: content.duplication(_main(s, d)),
        "template_pairs": lambda s, d: content.template_pairs(_texts(s, d)),
        "template_clusters": lambda s, d: content.template_clusters(_texts(s, d)),
        "freshness_dates": _dated,
        "policy_keywords": lambda s, d: content.policy_hits(_texts(s, d)),
        "policy_verdict": lambda s, d: content.policy_verdict(_texts(s, d)),
        "site_type_detect": _types,
        "site_scale": lambda s, d: crawl.site_pages(_pages(s, d)),
        "ai_parse_scores": lambda s, d: _parsed(s, d).select("reply_id", *replies.S.DIMENSIONS, "status", "page_type"),
        "ai_reply_texts": lambda s, d: _parsed(s, d).select("reply_id", "relevance_label", "assessment", *(f"{x}_reason" for x in replies.S.DIMENSIONS), F.array_join("suggestions", "; ").alias("suggestions")),
        "site_topics": _topics,
        "topic_cases": _topic_cases,
        "topic_replies": lambda s, d: topics.parse_topics(_beside(s, d, D.TOPICS, tables.inline(s, E.TOPICS, "site string, response string"))),
        "site_type_resolved": lambda s, d: topics.resolved_types(_types(s, d), _topics(s, d).where("type is not null")),
        "page_prompts": _prompts,
        "page_replies": lambda s, d: scorer.replies(_prompts(s, d), scorer.Rehearsal(), wait=0.0),
        "page_reply_scores": _scored_replies,
        "summary_replies": lambda s, d: topics.parse_summaries(_beside(s, d, D.SUMMARIES, _numbered(s, E.SUMMARIES, "reply_id int, response string"))),
        "page_details": _details,
        "page_records": lambda s, d: details.with_replies(_details(s, d), _parsed(s, d).withColumn("page_id", F.col("reply_id") - 1000)).withColumn("suggestions", F.array_join("suggestions", "; ")),
        "content_findings": lambda s, d: content.findings(_main(s, d), E.AS_OF),
        "report_phases": _phases,
        "problem_pages": lambda s, d: _details(s, d).where(details.is_problem()).select("site", "page_id", "display_status", "issues"),
        "pages_by_type": lambda s, d: details.pages_by_type(_details(s, d)),
        "report_markdown": lambda s, d: details.markdown(_report(s, d), details.pages_by_type(_details(s, d))),
        "report_lines": _lines,
        "site_approval": _approved,
        "crawl_candidates": lambda s, d: details.candidates(crawl.page_links(_pages(s, d)), _pages(s, d), CANDIDATES),
        "resource_items": _resources,
        "sitemap_sources": _sources,
        "flat_sitemap": lambda s, d: resources.flat_sitemap(_files(s, d).withColumnRenamed("sitemap", "site")),
        "dead_links": lambda s, d: crawl.split_responses(_responses(s, d))[1].select("site", "url", "reason"),
        "link_items": lambda s, d: resources.link_items(_home_links(s, d), _responses(s, d)),
        "page_ai_score": lambda s, d: replies.page_scores(_scored(s, d)).select("site", "page_id", "ai_score"),
        "page_vot": lambda s, d: replies.page_scores(_scored(s, d)).where("analysed").select("site", "page_id", "vot"),
        "site_ai_score": lambda s, d: replies.site_scores(_scored(s, d)).select("site", "ai_score"),
        "site_vot": lambda s, d: replies.site_scores(_scored(s, d)).select("site", "vot"),
        "ai_dimension_stats": lambda s, d: replies.dimension_stats(_scored(s, d)),
        "ai_compliance": lambda s, d: replies.compliance_item(_scored(s, d)),
        "score_caps": lambda s, d: replies.site_scores(_scored(s, d)).select("site", "least_compliance", "mean_relevance", "cap"),
        "check_items": _items,
        "category_scores": lambda s, d: report.category_scores(_items(s, d)),
        "hard_status": lambda s, d: report.status_counts(_items(s, d)).select("site", "hard_status", "passed", "warned", "failed", "pass_percent"),
        "warning_ratio": lambda s, d: report.status_counts(_items(s, d)).select("site", "warning_ratio", "penalty"),
        "composite_score": lambda s, d: report.composites(_beside(s, d, D.COMPOSITES, _numbered(s, E.COMPOSITES, "case_id int, vot int, site_quality int, home_quality int, least_compliance int, mean_relevance int"))),
        "approval_estimate": lambda s, d: report.approval(_beside(s, d, D.APPROVALS, _numbered(s, E.APPROVALS, "case_id int, composite int, hard_status string, ai_score int, least_originality int, low_percent int, n_pages int")).withColumn("low_ratio", F.col("low_percent") / 100)),
        "robots_sitemaps": _robots,
        "sitemap_expand": _expanded,
        "suggestion_dedup": _suggestions,
        "site_quality_report": _report,
        "saved_report_scores": _saved,
    }
