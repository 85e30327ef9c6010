"""How a crawl reaches a site's pages from its home page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.scratch import stored
from . import crawl


#: Rounds whose pages are written together again, so that the plan doesn't grow with the rounds.
TOGETHER = 8


def link_graph(pages: DataFrame, redirects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the first page of each normal URL of a site, and the distinct links between them that a crawl follows.

    redirects: site, url, target; a link to url leads to target, as does the page itself.
    Links of a repeated page don't count: a crawl fetches each normal URL once.
    """
    nodes = pages.select("site", "page_id", urls.normalised(F.col("url")).alias("norm_url")).groupBy("site", "norm_url").agg(F.min("page_id").alias("page_id"))
    links = crawl.page_links(pages).where((urls.site(F.col("href")) == F.col("site")) & urls.is_content(F.col("href")) & ~(urls.path(F.col("href")).isin("/", "") & F.col("href").contains("?")))
    edges = links.join(nodes.select("page_id", F.col("norm_url").alias("source")), "page_id").select("site", "source", urls.normalised(F.col("href")).alias("target")).distinct()
    if redirects is not None:
        moved = redirects.select("site", urls.normalised(F.col("url")).alias("target"), urls.normalised(F.col("target")).alias("to")).where("target <> to")
        edges = edges.join(moved, ["site", "target"], "left").select("site", "source", F.coalesce("to", "target").alias("target")).distinct()
        nodes = nodes.join(moved.select("site", F.col("target").alias("norm_url")), ["site", "norm_url"], "left_anti")
    return nodes, edges.where("source <> target")


def depths(pages: DataFrame, redirects: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """site, page_id, norm_url, depth: links from the home page to each page, null where none lead there (or more than `deepest`).

    A fixpoint: each round follows the links of the pages that the round before reached,
    leaves out those seen, and is written; it ends when a round reaches no page. The home page is the one with the
    site's least page_id.
    """
    nodes, edges = link_graph(pages, redirects)
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    home = nodes.groupBy("site").agg(F.min_by("norm_url", "page_id").alias("norm_url"))
    reached = stored(home.withColumn("depth", F.lit(0)), "depth")
    wave, depth = reached, 0
    while deepest is None or depth < deepest:
        depth += 1
        to = wave.select("site", F.col("norm_url").alias("source")).join(edges, ["site", "source"]).select("site", F.col("target").alias("norm_url")).distinct()
        new = to.join(nodes.select("site", "norm_url"), ["site", "norm_url"], "left_semi").join(reached.select("site", "norm_url"), ["site", "norm_url"], "left_anti")
        wave = stored(new.withColumn("depth", F.lit(depth)), "depth")
        if wave.isEmpty():
            break
        reached = reached.unionByName(wave)
        if depth % TOGETHER == 0:
            reached = stored(reached, "depth")
    return nodes.join(reached, ["site", "norm_url"], "left").select("site", "page_id", "norm_url", F.col("depth").cast("long").alias("depth"))


def reach(depths: DataFrame) -> DataFrame:
    """Per site: pages, those that a crawl reaches, those it doesn't, the depth of the deepest, and the mean depth."""
    return depths.groupBy("site").agg(F.count("*").alias("n_pages"), F.count("depth").alias("n_reached"), F.count_if(F.col("depth").isNull()).alias("n_unreachable"), F.max("depth").alias("deepest"), F.round(F.avg("depth"), 6).alias("mean_depth"))
