"""Which URLs to crawl: by freshness, and by weighted strata of page types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import rounded
from . import ranking

#: Characters by which suggestions are told apart.
OPENING = 40


def by_freshness(paths: DataFrame) -> DataFrame:
    """site, ordinal, path, date and rank within the site: later dates first, then as given."""
    df = paths.select("site", F.col("ordinal").cast("long").alias("ordinal"), "path", urls.path_date(F.col("path")).alias("date"))
    out = ranking.ranked(df, ["site"], [F.desc_nulls_last("date"), F.asc("ordinal")])
    return out.select("site", "ordinal", "path", F.col("date").cast("string").alias("date"), "rank")


def sample_by_type(pages: DataFrame, budget: int, most: int) -> DataFrame:
    """Per site up to `most` URLs: all of the always types, and of each other type its weighted share of the budget."""
    df = pages.select("site", "page_id", "url", urls.page_type(urls.path(F.col("url"))).alias("type")).where("type <> 'utility'")
    df = df.withColumn("w", urls.weight(F.col("type"), {k: float(v) for k, v in urls.SAMPLING_WEIGHTS.items()}, 3.0)).withColumn("always", F.col("type").isin("homepage", "required"))
    other = F.when(~F.col("always"), F.col("w")).otherwise(0.0)
    df = df.withColumn("total", F.sum(other).over(Window.partitionBy("site"))).withColumn("stratum", F.count("*").over(Window.partitionBy("site", "type")))
    quota = F.greatest(F.lit(1), rounded(F.col("w") * F.col("stratum") / F.col("total") * budget))
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy("site", "type").orderBy("page_id"))).where(F.col("always") | (F.col("rn") <= quota))
    last = Window.partitionBy("site").orderBy(F.desc("always"), F.desc("w"), "type", "page_id")
    return df.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= most).select("site", "page_id", "type", "rank")


def merged_suggestions(suggestions: DataFrame, actions: DataFrame) -> DataFrame:
    """site, position, suggestion: the actions of the site's summary as they are, then of its pages' suggestions the first of each opening of OPENING characters.

    Both inputs: site, ordinal, suggestion.
    """
    first = suggestions.groupBy("site", F.substring("suggestion", 1, OPENING).alias("opening")).agg(F.min(F.struct("ordinal", "suggestion")).alias("f")).select("site", F.lit(1).alias("late"), "f.ordinal", "f.suggestion")
    both = first.unionByName(actions.select("site", F.lit(0).alias("late"), F.col("ordinal").cast("long").alias("ordinal"), "suggestion"))
    return ranking.ranked(both, ["site"], [F.asc("late"), F.asc("ordinal"), F.asc("suggestion")], "position").select("site", "position", "suggestion")
