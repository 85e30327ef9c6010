"""Messages: languages, fallback, and the first occurrence of each name."""

from pyspark.sql import functions as F

from auditloom.functions import messages
from auditloom.functions import text as T
from auditloom.operators import content, details


def test_filled(spark):
    rows = [("{a} and {a}, {b} {c}", {"a": "1", "b": "{a}"}), ("none", {"a": "1"}), ("{a}{x}", {"a": None}), ("{a", {"a": "1"})]
    df = spark.createDataFrame(rows, "text string, params map<string,string>")
    assert [r[0] for r in df.select(messages.filled(F.col("text"), F.col("params"))).collect()] == ["1 and {a}, {a} {c}", "none", "{x}", "{a"]


def test_languages(spark):
    told = {lang: {r["key"]: r["text"] for r in messages.texts(spark, lang).collect()} for lang in ("en", "zh", "fr")}
    assert told["zh"]["pages"] == "## 页面" and told["zh"]["problem"] == told["en"]["problem"] and told["fr"] == told["en"]


def test_lines(spark):
    report = spark.createDataFrame([("s", 61, 58, "warn", 2, 1, 0)], "site string, composite long, soft_score long, hard_status string, passed long, warned long, failed long")
    items = spark.createDataFrame([("s", "about", "H", "warn"), ("s", "filler", "C", "pass"), ("s", "dup", "C", "fail")], "site string, item string, bucket string, status string")
    groups = spark.createDataFrame([("s", "homepage", 1, 0, 1), ("s", "content", 4, 1, 0)], "site string, page_type string, position long, n_problems long, n_ok long")
    own = spark.createDataFrame([("s", 7, "content", "warn", "Thin content (9 chars)", None, "warn"), ("s", 1, "homepage", "pass", "", "pass", "pass")], "site string, page_id long, page_type string, content_status string, issues string, ai_status string, display_status string")
    got = [r["line"] for r in details.report_lines(report, items, groups, own, "en").orderBy("part", "ordinal").collect()]
    assert got == ["# Audit of s", "Score 61 of 100, soft score 58; requirements: warn.", "2 checks passed, 1 to improve, 0 failed.", "## Requirements", "- about: to improve", "## Content", "- dup: failed", "- filler: passed", "## Pages", "- homepage: 0 with problems, 1 without", "- content: 1 with problems, 0 without", "## Pages with problems", "- 7: warn Thin content (9 chars)"]


def test_repeats(spark):
    """Units of ten to thirty characters of one line, four times or more in a row."""
    want = {"abcdefghij" * 4: 1, "abcdefghij" * 3: 0, "abcdefghi\n" * 4: 0, "abcdefgh\r!" * 4: 0, "ab" * 20: 1, "ab" * 19: 0, "x" * 40 + " - " + "é" * 45: 2, "a" * 9: 0, ("abcde fghij " * 5 + "\n") * 2: 2, "": 0}
    df = content.repeats(spark.createDataFrame([(k, t) for k, t in enumerate(want)], "k int, text string"), "k")
    assert {list(want)[r["k"]]: r["n_repeats"] for r in df.collect()} == want
    assert T.FILLER_REPEAT.count("(?s)") == 0
