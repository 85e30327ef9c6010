"""Items about files that a site serves beside its pages, and about dead links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEAD_SHARE, LEAST_LINKS = 0.2, 5


def resource_items(sites: DataFrame, resources: DataFrame) -> DataFrame:
    """site, item, bucket, status for robots.txt, sitemap.xml and ads.txt; a site without a row has none of them.

    resources: site, robots_ok, robots_txt, sitemap_ok, ads_ok. A robots.txt that could be
    read and names a sitemap stands for one.
    """
    c = F.col
    df = sites.select("site").distinct().join(resources, "site", "left")
    named = c("robots_ok") & F.col("robots_txt").rlike(r"(?im)^[ \t\r]*sitemap:\s*\S")
    flags = {"robots": c("robots_ok"), "sitemap": F.coalesce(c("sitemap_ok"), F.lit(False)) | F.coalesce(named, F.lit(False)), "ads": c("ads_ok")}
    rows = [F.struct(F.lit(n).alias("item"), F.when(F.coalesce(x, F.lit(False)), "pass").otherwise("warn").alias("status")) for n, x in flags.items()]
    return df.select("site", F.explode(F.array(*rows)).alias("r")).select("site", "r.item", F.lit("L").alias("bucket"), "r.status")


def sitemap_sources(default: DataFrame, robots: DataFrame) -> DataFrame:
    """site, url: pages of the default sitemap; where it names none, of those in robots.txt."""
    none = robots.join(default.select("site").distinct(), "site", "left_anti")
    return default.select("site", "url").unionByName(none.select("site", "url")).distinct()


def flat_sitemap(files: DataFrame) -> DataFrame:
    """site, url: what one sitemap names, whatever the scheme; indexes aren't followed."""
    return files.select("site", F.explode(F.regexp_extract_all("xml", F.lit("<loc>([^<]+)"), F.lit(1))).alias("url")).distinct()


def link_items(links: DataFrame, responses: DataFrame) -> DataFrame:
    """site, n_dead, dead_ratio, status: a fifth of the home page's links dead, or fewer than five within the site, warns.

    links: site, n_links, n_same_site of home pages. responses: site, url, status; none means no answer.
    """
    dead = responses.where(F.coalesce(F.col("status") >= 400, F.lit(True))).groupBy("site").agg(F.count("*").alias("n"))
    df = links.join(dead, "site", "left").withColumn("n_dead", F.coalesce("n", F.lit(0)))
    ratio = F.when(F.col("n_links") > 0, F.col("n_dead") / F.col("n_links")).otherwise(0.0)
    return df.select("site", "n_dead", F.round(ratio, 6).alias("dead_ratio"), F.when((ratio < DEAD_SHARE) & (F.col("n_same_site") >= LEAST_LINKS), "pass").otherwise("warn").alias("status"))
