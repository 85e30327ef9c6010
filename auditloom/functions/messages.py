"""What reports say, in two languages, as a table that is joined where texts are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK = "en"
#: Of each message its texts by language; where a language has none, the fallback's serves.
MESSAGES = {
    "head": {"en": "# Audit of {site}", "zh": "# {site} 的检查"},
    "score": {"en": "Score {composite} of 100, soft score {soft}; requirements: {hard}.", "zh": "得分 {composite}/100，软分 {soft}；要求：{hard}。"},
    "counts": {"en": "{passed} checks passed, {warned} to improve, {failed} failed.", "zh": "通过 {passed} 项，待改进 {warned} 项，未通过 {failed} 项。"},
    "bucket.H": {"en": "## Requirements", "zh": "## 要求"},
    "bucket.C": {"en": "## Content", "zh": "## 内容"},
    "bucket.L": {"en": "## Landing page", "zh": "## 首页"},
    "bucket.U": {"en": "## Use", "zh": "## 使用"},
    "item.pass": {"en": "- {item}: passed", "zh": "- {item}：通过"},
    "item.warn": {"en": "- {item}: to improve", "zh": "- {item}：待改进"},
    "item.fail": {"en": "- {item}: failed", "zh": "- {item}：未通过"},
    "pages": {"en": "## Pages", "zh": "## 页面"},
    "group": {"en": "- {type}: {bad} with problems, {ok} without", "zh": "- {type}：有问题 {bad}，无问题 {ok}"},
    "problems": {"en": "## Pages with problems", "zh": "## 有问题的页面"},
    "problem": {"en": "- {page}: {status} {issues}"},
}


def texts(spark: SparkSession, lang: str) -> DataFrame:
    """key, text of each message in a language; a few dozen rows."""
    return spark.createDataFrame([(k, t.get(lang, t[FALLBACK])) for k, t in MESSAGES.items()], "key string, text string")


def filled(text: Column, params: Column) -> Column:
    """A text with the first {name} of each entry of a map replaced by its value; other braces stay."""

    def put(done: Column, e: Column) -> Column:
        mark = F.concat(F.lit("{"), e["key"], F.lit("}"))
        at = F.instr(done, mark)
        return F.when(at > 0, F.overlay(done, F.coalesce(e["value"], F.lit("")), at, F.length(mark))).otherwise(done)

    return F.aggregate(F.map_entries(params), text, put)
