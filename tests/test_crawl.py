"""Addresses, required pages, ranks and the crawl by values worked out by hand."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from auditloom.functions import urls
from auditloom.operators import crawl, frontier, ranking, sampling

PAGES = "site string, page_id long, url string, html string"


def test_addresses(spark):
    base = "https://Ex.example:443/a/b/c?q=1#f"
    want = {
        "../x": "https://ex.example/a/x",
        "./..//x": "https://ex.example/a//x",
        "../../../x/": "https://ex.example/x/",
        ".": "https://ex.example/a/b/",
        "..": "https://ex.example/a/",
        "./": "https://ex.example/a/b/",
        "d/../e/./f?x=/../y": "https://ex.example/a/b/e/f?x=/../y",
        "/g/%2E%2e/h": "https://ex.example/h",
        "/.hidden/..x/x..": "https://ex.example/.hidden/..x/x..",
        "//Other.example": "https://other.example/",
        "HTTP://Other.example:80/a/./b": "http://other.example/a/b",
        "http://other.example:8080/": "http://other.example:8080/",
        "?r=2": "https://ex.example/a/b/c?r=2",
        "#s": "https://ex.example/a/b/c?q=1#s",
        "": "https://ex.example/a/b/c?q=1",
        " x\ny ": "https://ex.example/a/b/xy",
        "mailto:w@x.example": "mailto:w@x.example",
    }
    df = spark.createDataFrame([(k, base) for k in want], "raw string, url string")
    assert {r[0]: r[1] for r in df.select("raw", crawl.resolved(F.col("raw"), F.col("url"))).collect()} == want


def test_folded_paths_as_another_resolver(spark):
    rng = random.Random(3)
    paths = {"/" + "/".join(rng.choice(("a", "b", "..", ".", "c.d")) for _ in range(rng.randint(1, 7))) for _ in range(300)}
    got = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", urls.folded(F.col("p"))).collect()}
    assert got == {p: urljoin("http://h/", p).removeprefix("http://h") for p in paths}


def test_links_in_any_quotes(spark):
    html = "<a data-href='no' href=\"it's\">A</a><a class=x href='b\"c'>B</a><a href=/u/v>C</a><a href=w class=y>D</a><area href='no'><a name=x>E</a><A HREF = 'z'>F</A>"
    got = crawl.page_links(spark.createDataFrame([("s.example", 1, "https://s.example/p/", html)], PAGES)).orderBy("pos").collect()
    assert [(r["href"], r["anchor_text"]) for r in got] == [("https://s.example/p/it's", "A"), ("https://s.example/p/b\"c", "B"), ("https://s.example/u/v", "C"), ("https://s.example/p/w", "D"), ("https://s.example/p/z", "F")]


def test_required_pages(spark):
    link = lambda u, t: f"<a href='{u}'>{t}</a>"
    html = link("/x", "Our privacy") + link("/y", "关于") + link("/legal", "L") + link("/z", "About all") + link("/about-2", "-") + link("/about-1", "-")
    pages = spark.createDataFrame([("s.example", 1, "https://s.example/", html), ("t.example", 2, "https://t.example/", "")], PAGES)
    sitemap = spark.createDataFrame([("s.example", 8, "https://s.example/terms"), ("s.example", 9, "https://s.example/CONTACT-us")], "site string, page_id long, url string")
    found = {(r["site"][0], r["required"]): (r["found_by"], r["found_url"]) for r in crawl.required_pages(pages, sitemap).collect()}
    # an address goes before any text; of two patterns the first one's sitemap hit goes before the second one's link
    assert found["s", "about"] == ("url", "https://s.example/about-2") and found["s", "privacy"] == ("text", "https://s.example/x")
    assert found["s", "contact"] == ("sitemap", "https://s.example/CONTACT-us") and found["s", "terms"] == ("sitemap", "https://s.example/terms")
    assert found["t", "about"] == ("missing", None) and len(found) == 8
    alone = {r["required"]: r["found_url"] for r in crawl.required_pages(pages.where("site = 's.example'")).collect()}
    assert alone["terms"] == "https://s.example/legal" and alone["contact"] is None


def test_ranks_of_a_hot_group(spark):
    """Ranks are those of a sort, also where one group holds most rows, and no window or single task is in the plan."""
    rng = random.Random(7)
    rows = [(rng.choice(("hot", "hot", "hot", "a", "b", None)), rng.randrange(50), k) for k in range(3000)]
    df = ranking.ranked(spark.createDataFrame(rows, "g string, v int, k int").repartition(5), ["g"], [F.desc("v"), F.asc("k")])
    found = {r["k"]: r["rank"] for r in df.collect()}
    want = {}
    for g in ("hot", "a", "b", None):
        for at, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = at
    assert found == want
    plan = df._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert sorted(r["rank"] for r in ranking.ranked(spark.createDataFrame(rows, "g string, v int, k int"), [], [F.asc("k")]).collect()) == list(range(1, 3001))


def test_freshness_rank(spark):
    rows = [("s", 0, "/x"), ("s", 1, "/2024/05/25"), ("s", 2, "/2025/x"), ("s", 3, "/x2"), ("t", 4, "/2020")]
    got = {(r["site"], r["path"]): (r["rank"], r["date"]) for r in sampling.by_freshness(spark.createDataFrame(rows, "site string, ordinal int, path string")).collect()}
    assert got == {("s", "/2025/x"): (1, "2025-06-15"), ("s", "/2024/05/25"): (2, "2024-05-25"), ("s", "/x"): (3, None), ("s", "/x2"): (4, None), ("t", "/2020"): (1, "2020-06-15")}


def test_a_number_is_no_year(spark):
    """More than four digits are a number; months and days of more than two digits are none either."""
    want = {"/de/20289": None, "/20248/05/06": None, "/2024": "2024-06-15", "/2024x": "2024-06-15", "/20289/2024-05": "2024-05-15", "/2024/123": "2024-06-15", "/2024/05/251": "2024-05-15"}
    df = spark.createDataFrame([("s", k, p) for k, p in enumerate(want)], "site string, ordinal int, path string")
    assert {r["path"]: r["date"] for r in sampling.by_freshness(df).collect()} == want


def test_suggestions(spark):
    own = [("s", 1, "x" * 40 + "a"), ("s", 2, "x" * 40 + "b"), ("s", 3, "y"), ("t", 4, "y")]
    acts = [("s", 0, "y"), ("s", 1, "y")]
    schema = "site string, ordinal long, suggestion string"
    got = sampling.merged_suggestions(spark.createDataFrame(own, schema), spark.createDataFrame(acts, schema)).orderBy("site", "position").collect()
    assert [tuple(r) for r in got] == [("s", 1, "y"), ("s", 2, "y"), ("s", 3, "x" * 40 + "a"), ("s", 4, "y"), ("t", 1, "y")]


def chain(n):
    return [("s.example", k, f"https://s.example/{k}", f"<a href='/{k + 1}#x'>n</a><a href='/{max(0, k - 3)}/'>b</a>") for k in range(n)]


def test_depths(spark, monkeypatch):
    """A long chain, pages that nothing leads to, links back, other sites, static files, repeated pages and redirects."""
    monkeypatch.setattr(frontier, "TOGETHER", 3)
    rows = chain(12) + [("s.example", 90, "https://s.example/90", "<a href='/91'>x</a>"), ("s.example", 91, "https://s.example/91", ""), ("s.example", 92, "https://s.example/3/", "<a href='/90'>not followed</a>")]
    rows += [("t.example", 200, "https://t.example/", "<a href='https://s.example/1'>x</a><a href='/a.pdf'>x</a><a href='/?q=1'>x</a><a href='/old'>x</a>"), ("t.example", 201, "https://t.example/a.pdf", ""), ("t.example", 202, "https://t.example/old", ""), ("t.example", 203, "https://t.example/new", "<a href='/next'>x</a>"), ("t.example", 204, "https://t.example/next", "")]
    pages = spark.createDataFrame(rows, PAGES)
    found = {r["page_id"]: r["depth"] for r in frontier.depths(pages).collect()}
    assert found == {k: k for k in range(12)} | {90: None, 91: None, 200: 0, 201: None, 202: 1, 203: None, 204: None}
    moved = spark.createDataFrame([("t.example", "https://t.example/old/", "https://t.example/new#a")], "site string, url string, target string")
    found = {r["page_id"]: r["depth"] for r in frontier.depths(pages.where("site = 't.example'"), moved).collect()}
    assert found == {200: 0, 201: None, 203: 1, 204: 2}
    assert max(r["depth"] or 0 for r in frontier.depths(pages, deepest=2).collect()) == 2
    r = {x["site"]: x for x in frontier.reach(frontier.depths(pages)).collect()}["s.example"]
    assert (r["n_pages"], r["n_reached"], r["n_unreachable"], r["deepest"], r["mean_depth"]) == (14, 12, 2, 11, 5.5)
