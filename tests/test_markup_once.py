"""Expressions that read a text once for all they tell of it."""

from pyspark.sql import functions as F

from auditloom.operators import content, crawl


def test_texts_are_searched_once(spark):
    df = spark.createDataFrame([(1, "2024-5-06, 2024年7月8日 March 3, 2025; 4 Sept 2023. May 2022")], "text_id long, text string")
    out = content.dates(df, "2100-01-01")
    assert {str(r["date"]) for r in out.collect()} == {"2024-05-06", "2024-07-08", "2025-03-03", "2023-09-04", "2022-05-01"}
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 4
    html = "<a href='x'>A</a><h1>a</h1><h3>b</h3><h2>c</h2>"
    own = spark.createDataFrame([(html,), ("<h3>a</h3><h2>b</h2>",), ("",)], "html string")
    levels = crawl.heading_levels(F.col("html"))
    got = own.select(crawl.skips(levels, -1).alias("down"), crawl.skips(levels, 1).alias("up"))
    assert [tuple(r) for r in got.collect()] == [(True, False), (False, False), (False, False)]
    assert got._jdf.queryExecution().analyzed().toString().split("+-")[0].count("regexp_extract_all(") == 2
    assert own.select(crawl.anchors(F.col("html")).alias("a"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
