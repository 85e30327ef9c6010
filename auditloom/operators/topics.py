"""What a site is about: from its home page's metadata, or from a model's reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import crawl

#: Types that a reply may name; menus of tools and of reference works.
SITE_TYPES = ("content", "tool", "game", "video", "reference")
TOOLS, WORKS = "calc|convert|generator|tool|checker|builder", "wiki|glossary|encyclopedia|dictionary|reference|archive"


def home_topics(meta: DataFrame) -> DataFrame:
    """site, meta_score, meta_incomplete, type, topic, description, confidence from each site's first page.

    Of metadata with fewer than two points nothing is told: a model has to be asked.
    """
    c = F.col
    first = lambda name: F.min_by(name, "page_id").alias(name)
    home = meta.groupBy("site").agg(*(first(n) for n in ("title", "description", "og_description", "h1_text", "nav_text")))
    said = F.coalesce(F.nullif("description", F.lit("")), "og_description")
    title, h1 = T.trimmed(c("title")), c("h1_text")
    size = F.length(said)
    point = lambda x: F.when(x, 1).otherwise(0)
    home = home.withColumn("meta_score", (point(F.length(title) > 5) + point(size > 20) + point(size > 100)).cast("long"))
    told = lambda x: F.when(c("meta_score") >= 2, x)
    about = F.when(said != "", said).when(h1 != title, h1).otherwise("")
    return home.select(
        "site",
        "meta_score",
        (c("meta_score") < 2).alias("meta_incomplete"),
        told(F.when(c("nav_text").rlike(f"(?i){TOOLS}"), "tool").when(c("nav_text").rlike(f"(?i){WORKS}"), "reference").otherwise("content")).alias("type"),
        told(F.when(title != "", title).when(h1 != "", h1).otherwise("Unknown")).alias("topic"),
        told(F.substring(about, 1, 300)).alias("description"),
        told(F.when((title != "") & (size > 50), "high").otherwise("medium")).alias("confidence"),
    )


def parse_topics(replies: DataFrame) -> DataFrame:
    """site, response to type, topic, description, confidence, reasoning, is_ymyl and focus (1 to 10).

    A type that isn't known makes the site unsupported, as does a reply without an object.
    """
    body = F.nullif(F.regexp_extract("response", r"(?s)\{.*\}", 0), F.lit(""))
    df = replies.withColumn("body", F.when(F.json_object_keys(body).isNotNull(), body))
    read = lambda name: F.get_json_object("body", f"$.{name}")
    there = F.col("body").isNotNull()
    or_else = lambda name, value, failed: F.when(there, F.coalesce(read(name), F.lit(value))).otherwise(failed)
    focus = F.when(F.regexp_count("body", F.lit(r'"nicheFocusScore"\s*:\s*"')) == 0, read("nicheFocusScore").try_cast("double"))
    return df.select(
        "site",
        F.when(read("type").isin(*SITE_TYPES), read("type")).otherwise("unsupported").alias("type"),
        or_else("topic", "Unknown", "Unknown").alias("topic"),
        or_else("description", "", "Topic analysis failed").alias("description"),
        or_else("confidence", "low", "low").alias("confidence"),
        F.when(there, F.coalesce(read("isYMYL") == "true", F.lit(False))).alias("is_ymyl"),
        F.when(focus.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(10.0), focus))).alias("focus"),
    )


def resolved_types(types: DataFrame, topics: DataFrame) -> DataFrame:
    """site, type, confidence: a topic's type, where there is one, goes before what the markup shows."""
    told = topics.select("site", F.col("type").alias("told"), F.col("confidence").alias("sure"))
    return types.join(told, "site", "left").select("site", F.coalesce("told", "type").alias("type"), F.when(F.col("told").isNotNull(), F.col("sure")).otherwise(F.col("confidence")).alias("confidence"))


#: What a reply must hold: all that parse_replies() reads.
ASKED = """You judge pages for an advertising programme. Answer with one JSON object and nothing else.
pageType: one of homepage, listing, content, game_detail, video_detail, reference_detail, required, utility.
evaluation_details: an object with value, originality, relevance, compliance and translation, each from 0 to 10, and with the reason of each in value_reason, originality_reason, relevance_reason, compliance_reason and translation_reason.
relevanceLabel: relevant, tangential or off-topic. confidence: high, medium or low. assessment: a short text. suggestions: one to three texts.
"""


def prompts(pages: DataFrame, topics: DataFrame, date: str, language: str = "English", most: int = 5000) -> DataFrame:
    """site, page_id, prompt: what a model is asked about a page, with the date, the reply's language, the site's topic, what the markup shows, and the text's first characters."""
    told = topics.select("site", "topic", "type", "description")
    html = F.col("html")
    own = crawl.page_signals(pages, F.col("url"), T.visible(html).alias("text"), crawl.language(html).alias("lang"))
    part = lambda head, value: F.when(value.isNotNull(), F.concat(F.lit(head), value, F.lit("\n"))).otherwise("")
    said = lambda c: F.col(c).cast("string")
    embed = F.when((F.col("iframes") > 0) | (F.col("canvases") > 0), "game").when(F.col("videos") > 0, "video").otherwise("none")
    listing = F.concat(F.lit("Listing: "), said("list_items"), F.lit(" items, pagination "), said("has_pagination"), F.lit(", categories "), said("has_categories"), F.lit(", search "), said("has_search"), F.lit("\n"))
    declared = F.concat(F.lit("Declared language: "), F.when(F.col("lang") == "", "English").otherwise(F.col("lang")), F.lit("\n"))
    head = F.lit(f"{ASKED}Date: {date}\nLanguage of the reply: {language}\n")
    df = own.join(told, "site", "left")
    return df.select("site", "page_id", F.concat(head, part("Topic: ", F.col("topic")), part("Type: ", F.col("type")), part("About: ", F.col("description")), declared, F.lit("Embed: "), embed, F.lit("\n"), listing, F.lit("Page: "), F.col("url"), F.lit("\n\n"), F.substring("text", 1, most)).alias("prompt"))


def json_list(body: Column | str, name: str) -> Column:
    """A JSON array of texts as an array; absent or no array gives an empty one."""
    return F.coalesce(F.from_json(F.get_json_object(body, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))


def parse_summaries(replies: DataFrame) -> DataFrame:
    """reply_id, response to a verdict on a site; a reply without an object gives no row."""
    body = F.nullif(F.regexp_extract("response", r"(?s)\{.*\}", 0), F.lit(""))
    df = replies.withColumn("body", F.when(F.json_object_keys(body).isNotNull(), body)).where("body is not null")
    text = lambda name: F.coalesce(F.get_json_object("body", f"$.{name}"), F.lit(""))
    number = F.get_json_object("body", "$.probability").try_cast("double")
    return df.select(
        F.col("reply_id").cast("long").alias("reply_id"),
        F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number))).alias("probability"),
        text("verdict").alias("verdict"),
        text("analysis").alias("analysis"),
        F.array_join(json_list("body", "reasons"), "; ").alias("reasons"),
        F.array_join(json_list("body", "topActions"), "; ").alias("actions"),
        text("detailedSummary").alias("summary"),
    )
