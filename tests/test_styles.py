"""Style rules by pages worked out by hand."""

from pyspark.sql import functions as F

from auditloom import plans
from auditloom.operators import styles

DATA = "/root/testdata/sf0.001"


def told(spark, *pages):
    df = spark.createDataFrame([("s", k, "u", h) for k, h in enumerate(pages)], "site string, page_id long, url string, html string")
    return [(r["small_letters"], r["popups"], r["unseen_frames"]) for r in styles.page_styles(df).orderBy("page_id").collect()]


def test_examples(spark):
    got = {r["page_id"] - 10**12: r for r in plans.queries()["page_styles"](spark, DATA).where("site = 'cases.example'").collect()}
    assert [(got[k]["small_letters"], got[k]["popups"], got[k]["unseen_frames"]) for k in (9, 10)] == [(3, 0, 0), (0, 3, 3)]
    # frames: one of 50 pixels, one hidden by its attribute
    assert got[2]["unseen_frames"] == 2 and got[8]["small_letters"] == 0


def test_which_rule_wins(spark):
    rule = lambda css, body: f"<style>{css}</style>{body}"
    pages = [
        rule("p{font-size:9px}p{font-size:14px}", "<p>later</p>"),
        rule(".a{font-size:9px}p{font-size:14px}", "<p class='a'>class before tag</p>"),
        rule("#i{font-size:14px}.a{font-size:9px}", "<p class='a' id=i>id before class</p>"),
        rule("p.a{font-size:9px}.a{font-size:14px}", "<p class='b a'>tag and class before class</p>"),
        rule("p{font-size:9px}", "<p style=\"font-size:14px\">attribute</p><div>no letters</div>"),
        rule("div p{font-size:9px}p>a{font-size:9px}p:hover{font-size:9px}[x]{font-size:9px}", "<p>not simple</p>"),
        rule("p{font-size:0}", "<p>no size</p>") + rule("a{font-size:.5em}span{font-size:9.1pt}li{font-size:smaller}", "<a>8 px</a><span>12.1 px</span><li>?</li>"),
        "<style>p{font-size:9px",
        "",
    ]
    assert [x[0] for x in told(spark, *pages)] == [0, 1, 0, 1, 0, 0, 1, 0, 0]


def test_lengths(spark):
    want = {"12px": 12.0, "9pt": 12.0, "1.5em": 24.0, ".5rem": 8.0, "7": 7.0, "50%": None, "auto": None, "-3px": None, None: None}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r[0]: r[1] for r in df.select("x", styles.pixels(F.col("x"))).collect()} == want


def test_no_pages(spark):
    assert told(spark, "<p>x</p>") == [(0, 0, 0)]
    assert styles.page_styles(spark.createDataFrame([], "site string, page_id long, url string, html string")).collect() == []
