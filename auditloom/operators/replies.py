"""Language-model replies: parsed scores, page status, and what sites make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import urls
from ..functions.text import rounded

#: Page types that a reply may name.
PAGE_TYPES = ("homepage", "listing", "content", "game_detail", "video_detail", "reference_detail", "required", "utility")


def parse_replies(replies: DataFrame) -> DataFrame:
    """reply_id, lang, response to five scores, a status, reasons and suggestions; a reply without an object gives nulls and warn.

    Low and medium confidence lower value and originality; pages that only serve a function
    and English pages are not held to what can't apply to them.
    """
    body = F.nullif(F.regexp_extract("response", r"(?s)\{.*\}", 0), F.lit(""))
    body = F.when(F.json_object_keys(body).isNotNull(), body)
    nested = F.get_json_object("body", "$.evaluation_details")
    df = replies.withColumn("body", body).withColumn("reply", F.when(nested.startswith("{"), nested).otherwise(F.col("body")))
    df = df.withColumns({d: S.clamped(F.col("reply"), d) for d in S.DIMENSIONS})
    trust = F.get_json_object("body", "$.confidence")
    kind = F.get_json_object("body", "$.pageType")
    kind = F.when(kind.isin(*PAGE_TYPES), kind)
    penalty = F.when(trust == "low", 2).when(trust == "medium", 1).otherwise(0)
    serves = F.coalesce(kind.isin("required", "utility"), F.lit(False))
    own = {d: F.greatest(F.lit(0), F.col(d) - penalty) if d in ("value", "originality") else F.col(d) for d in S.DIMENSIONS}
    own = {d: x if d == "compliance" else F.when(serves, 10).otherwise(x) for d, x in own.items()}
    own["translation"] = F.when(serves | F.coalesce(F.col("lang").isin("", "en"), F.lit(True)), 10).otherwise(F.col("translation"))
    df = df.withColumns({d: F.when(F.col("body").isNotNull(), x).cast("long") for d, x in own.items()})
    mean = S.geometric([F.col(d) for d in S.DIMENSIONS])
    status = F.when(F.col("body").isNull(), "warn").when(mean >= 7, "pass").when(mean >= 4, "warn").otherwise("fail")
    text = lambda at, name: F.coalesce(F.get_json_object(at, f"$.{name}"), F.lit(""))
    known = lambda x: F.when(F.col("body").isNotNull(), x)
    label = F.coalesce(F.get_json_object("body", "$.relevanceLabel"), F.when(F.col("relevance") >= 7, "relevant").when(F.col("relevance") >= 4, "tangential").otherwise("off-topic"))
    texts = [known(label).alias("relevance_label"), F.coalesce(known(text("body", "assessment")), F.lit("Analysis failed")).alias("assessment")]
    texts += [known(text("reply", f"{d}_reason")).alias(f"{d}_reason") for d in S.DIMENSIONS]
    texts += [F.coalesce(F.from_json(F.get_json_object("body", "$.suggestions"), "array<string>"), F.array().cast("array<string>")).alias("suggestions")]
    return df.select(F.col("reply_id").cast("long").alias("reply_id"), *S.DIMENSIONS, status.alias("status"), kind.alias("page_type"), *texts)


def stand_in_scores(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of pages from labels, standing in for replies; pages without a label have none."""
    marks = labels.select(F.col("doc_id").alias("page_id"), "quality", "toxic")
    df = pages.select("site", "page_id", urls.page_type(urls.path(F.col("url"))).alias("type")).join(marks, "page_id", "left")
    there = F.col("quality").isNotNull()
    made = {"value": 3 + 5 * F.col("quality"), "originality": 4 + F.col("page_id") % 6, "relevance": 5 + F.col("page_id") % 5, "compliance": 10 - 8 * F.col("toxic"), "translation": 6 + F.col("page_id") % 4}
    return df.select("site", "page_id", "type", *(F.when(there, x).cast("long").alias(d) for d, x in made.items()))


def page_scores(scored: DataFrame) -> DataFrame:
    """The five-score and the three-score geometric means of each page."""
    all_, three = [F.col(d) for d in S.DIMENSIONS], [F.col(d) for d in ("value", "originality", "translation")]
    return scored.select("site", "page_id", "type", S.page_score(all_).alias("ai_score"), F.round(S.geometric(three) * 10, 6).alias("vot"), F.col("value").isNotNull().alias("analysed"), "relevance", "compliance")


def _weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def site_scores(scored: DataFrame) -> DataFrame:
    """Per site: weighted mean of page scores, weighted mean value, and the cap that bad pages set."""
    df = page_scores(scored).withColumn("w", urls.weight(F.col("type"), urls.SCORE_WEIGHTS, 0.5))
    counts = F.col("analysed") & ~F.col("type").isin("required", "utility")
    df = df.groupBy("site").agg(
        rounded(_weighted(F.col("ai_score"), F.col("w"))).alias("ai_score"),
        # with replies, but none of a page that counts, the value is 0
        F.when(F.bool_or("analysed"), F.round(F.coalesce(_weighted(F.when(counts, F.col("vot")), F.when(counts, F.col("w"))), F.lit(0.0)), 6)).alias("vot"),
        F.min("compliance").alias("least_compliance"),
        F.avg("relevance").alias("mean_relevance"),
    )
    cap = F.when(F.col("least_compliance") < 6, 50).when(F.col("mean_relevance") < 6, 60).otherwise(100)
    return df.select("site", "ai_score", "vot", "least_compliance", F.round("mean_relevance", 6).alias("mean_relevance"), cap.cast("long").alias("cap"))


def dimension_stats(scored: DataFrame) -> DataFrame:
    """Per site and score: mean, least, how many pages lie below 6 and their share; missing ones count 5."""
    rows = [F.struct(F.lit(d).alias("dimension"), F.coalesce(d, F.lit(S.MISSING)).cast("long").alias("v")) for d in S.DIMENSIONS]
    long = scored.select("site", F.explode(F.array(*rows)).alias("r")).select("site", "r.dimension", "r.v")
    low = F.count_if(F.col("v") < 6)
    return long.groupBy("site", "dimension").agg((F.floor(F.avg("v") * 10 + 0.5) / 10).alias("mean"), F.min("v").alias("least"), low.alias("n_low"), (F.floor(low * 1000 / F.count("*") + 0.5) / 10).alias("low_percent"))


def compliance_item(scored: DataFrame) -> DataFrame:
    """Per site with analyses: pass, warn or fail by how many pages are grave (2 or less) or doubtful (5 or less), and the mean."""
    c = F.coalesce("compliance", F.lit(S.MISSING))
    df = scored.groupBy("site").agg(F.count("*").alias("n"), F.count("compliance").alias("known"), F.count_if(c <= 2).alias("n_grave"), F.count_if((c > 2) & (c <= 5)).alias("n_doubtful"), F.round(F.avg(c), 6).alias("mean_compliance"))
    status = F.when(F.col("n_grave") > 0, "fail").when(F.col("n_doubtful") > 0.2 * F.col("n"), "warn").otherwise("pass")
    return df.where("known > 0").select("site", "n_grave", "n_doubtful", "mean_compliance", status.alias("status"))
