"""Score expressions: language-model replies, page and site scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded

DIMENSIONS = ("value", "originality", "relevance", "compliance", "translation")
#: What a missing score counts as.
MISSING = 5


def clamped(reply: Column, name: str) -> Column:
    """A score of a JSON object as a whole number from 0 to 10; null counts 0, absent or no number 5."""
    raw = F.get_json_object(reply, f"$.{name}")
    there = F.array_contains(F.json_object_keys(reply), name)
    number = F.when(F.trim(raw) == "", F.lit(0.0)).otherwise(raw.try_cast("double"))
    score = F.greatest(F.lit(0), F.least(F.lit(10), rounded(F.coalesce(number, F.lit(float(MISSING))))))
    return F.when(~there, F.lit(MISSING)).when(raw.isNull(), F.lit(0)).otherwise(score).cast("long")


def geometric(columns: list[Column]) -> Column:
    """The geometric mean, missing scores as 5."""
    product = F.lit(1.0)
    for c in columns:
        product = product * F.coalesce(c, F.lit(MISSING)).cast("double")
    return F.pow(product, F.lit(1.0 / len(columns)))


def page_score(columns: list[Column]) -> Column:
    return rounded(geometric(columns) * 10)


def status_points(status: Column) -> Column:
    return F.when(status == "pass", 100).when(status == "warn", 40).otherwise(0)


def composite(vot: Column, site: Column, home: Column, cap: Column) -> Column:
    """Value scaled by site and home quality, below the cap; without a value the mean of both stands in for it."""
    v = F.coalesce(vot.cast("double"), rounded((site + home) / 2).cast("double"))
    return F.greatest(F.lit(0), F.least(F.lit(100), rounded(F.least(v * site / 100 * home / 100, cap.cast("double"))))).cast("long")
