"""Rules by values worked out by hand, independent of the queries' SQL."""

import pytest
from pyspark.sql import functions as F

from auditloom import plans
from auditloom.functions import scores as S
from auditloom.functions import urls
from auditloom.operators import report, replies

DATA = "/root/testdata/sf0.001"
LONG = "<p>" + "Words of a text that goes on. " * 30 + "</p>"


def page(body, head=""):
    return f"<html><head>{head}</head><body><nav>menu</nav>{body}</body></html>"


@pytest.fixture(scope="module")
def items(spark):
    frame = "<iframe src=\"https://a.example/embed\"></iframe>"
    own = lambda k: page(f"<p>{k} " + "".join(f"{k}w{i} " for i in range(120)) + "</p>")
    rows = [("game", page(LONG)), ("game", page(frame * 21)), ("game", page(frame + LONG)), ("game", page("x")), ("game", page(frame))]
    rows += [("video", page(LONG)), ("video", page("<p>short</p>")), ("reference", page("x")), ("reference", page(LONG))]
    rows += [("plain", own("a")), ("plain", page("<p>Updated 2025-03-14</p>")), ("one", page("hi casino"))]
    df = spark.createDataFrame([(s, k, f"https://{s}.example/{k}", h) for k, (s, h) in enumerate(rows)], "site string, page_id long, url string, html string")
    comply = spark.createDataFrame([("one", "pass", 7.0), ("game", "fail", 2.0)], "site string, status string, mean_compliance double")
    types = spark.createDataFrame([("game", "game"), ("video", "video"), ("reference", "reference")], "site string, type string")
    out = {}
    for r in report.check_items(df, comply, types, "2025-06-30").collect():
        out.setdefault(r["site"], {})[r["item"]] = r["status"]
    return out


def test_items_by_type(items):
    plain = {"content_ratio", "filler", "home_content"}
    for site in ("game", "video", "reference"):
        assert not (plain | {"subpage_depth"}) & items[site].keys()
    assert plain <= items["plain"].keys() and plain <= items["one"].keys()
    # two of three pages with embeds are thin, and frames are 23
    assert (items["game"]["game_description"], items["game"]["iframe_quality"]) == ("warn", "warn")
    assert items["video"]["video_description"] == "warn" and items["reference"]["reference_entry"] == "pass"
    assert items["plain"]["subpage_depth"] == "fail" and "subpage_depth" not in items["one"]
    assert items["plain"]["freshness"] == "pass" and items["video"]["freshness"] == "warn"
    # a short page fails the word check; a mean compliance of 7 softens that
    assert items["one"]["policy_keywords"] == "warn" and items["one"]["ai_compliance"] == "pass" and items["game"]["ai_compliance"] == "fail"
    assert "template" in items["game"] and "template" not in items["plain"]


def test_scores(spark):
    rows = [(1, 97.0, 94.0, 90.0, 100), (2, 97.0, 94.0, 90.0, 50), (3, 97.0, 94.0, 90.0, 60), (4, None, 80.0, 60.0, 100)]
    df = spark.createDataFrame(rows, "k int, vot double, site double, home double, cap int")
    assert [r[0] for r in df.orderBy("k").select(S.composite(F.col("vot"), F.col("site"), F.col("home"), F.col("cap"))).collect()] == [82, 50, 60, 34]


def test_replies(spark):
    flat = '{"value": 8, "originality": 7, "relevance": 9, "compliance": 10, "translation": 2, '
    rows = [(1, "fr", flat + '"confidence": "low"}'), (2, "EN", flat + '"confidence": "Low", "pageType": "unknown"}'), (3, "", flat + '"pageType": "listing"}'), (4, "fr", "none")]
    got = {r["reply_id"]: r for r in replies.parse_replies(spark.createDataFrame(rows, "reply_id long, lang string, response string")).collect()}
    assert (got[1]["value"], got[1]["originality"], got[1]["translation"]) == (6, 5, 2)
    assert (got[2]["value"], got[2]["translation"], got[2]["page_type"]) == (8, 2, None)
    assert (got[3]["translation"], got[3]["page_type"]) == (10, "listing") and (got[4]["value"], got[4]["status"]) == (None, "warn")


def test_extraction(spark):
    q = plans.queries()
    got = {r["page_id"] - 10**12: r for r in q["signal_cases"](spark, DATA).where("site = 'cases.example'").collect()}
    assert [got[k]["iframes"] for k in range(9)] == [0, 0, 3, 0, 0, 0, 0, 0, 0] and got[2]["sources"] == "https://f.example/1 https://l.example/"
    assert [got[k]["list_items"] for k in range(9)] == [0, 0, 0, 3, 2, 0, 0, 0, 0] and got[1]["game_links"] == 2
    flags = {k: "".join(n for n, c in (("p", "has_pagination"), ("c", "has_categories"), ("s", "has_search")) if got[k][c]) for k in got}
    assert flags == {0: "", 1: "p", 2: "", 3: "cs", 4: "pcs", 5: "pcs", 6: "ps", 7: "ps", 8: "", 9: "", 10: ""}
    meta = {r["page_id"] - 10**12: r for r in q["meta_cases"](spark, DATA).where("site = 'cases.example'").collect()}
    assert [meta[k]["lang"] for k in (0, 1, 2)] == ["", "fr", "en"] and meta[1]["og_description"] == "og" and meta[0]["h1_text"] == "One Two"
    assert [r["href"] for r in q["link_cases"](spark, DATA).where("site = 'cases.example' and page_id < 1000000000002").orderBy("page_id", "pos").collect()] == ["https://cases.example/" + x for x in ("x", "a/c", "a/b?r", "a/b?q=1#s", "a/games/t")] + ["https://other.example/GAME/u", "https://cases.example/v"]


def test_page_types(spark):
    want = {"/": "homepage", "/about-us": "required", "/blog/about-x": "required", "/en/login": "utility", "/ja/blog/my-post": "content", "/games/x": "game_detail", "/watch/1": "video_detail", "/wiki/Topic": "reference_detail", "/archive": "reference_listing", "/tv": "listing", "/ja/categories": "unknown", "/Blog/x": "unknown"}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r[0]: r[1] for r in df.select("p", urls.page_type(F.col("p"))).collect()} == want


def test_main_texts_at_hand_are_taken(spark, monkeypatch):
    """Items of pages whose main texts are known work out none."""
    pages = spark.createDataFrame([("m.example", k, f"https://m.example/{k}", page("<h1>One</h1><p>Some words.</p>")) for k in range(2)], "site string, page_id long, url string, html string")
    main = pages.selectExpr("site", "page_id", "url", "repeat('x', 600) AS text", "repeat('x', 600) AS main_text")
    monkeypatch.setattr(report.boilerplate, "main_content", lambda _: pytest.fail("worked out again"))
    found = {r["item"]: r["status"] for r in report.check_items(pages, main=main).collect()}
    assert found["home_content"] == found["content_ratio"] == "pass" and found["h1"] == "pass"
