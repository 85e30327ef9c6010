"""What a page's markup says: text, metadata, links, signals, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from . import ranking

#: A link's address, in double, single or no quotes, and its markup.
ANCHOR = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
#: Hosts of adverts.
ADVERTS = "googlesyndication|doubleclick|adservice|adsense|pagead|adnxs|amazon-adsystem|facebook\\.com/plugins|google\\.com/ads|googletagmanager|googletagservices"
#: Classes of listed things, of pagination, of groups of things, of search forms.
CARDS = "card|item|entry|post|game-card|video-card|list-item|result-item"
PAGINATION = "pagination|page-nav"
GROUPS = "categories|category-list|tags|tag-list|genres|genre-list"
SEARCH = "search-form|search-box"
TAG, FRAME = r"(?is)<[a-z][a-z0-9]*(?:\s[^>]*)?>", r"(?is)<iframe(?:\s[^>]*)?>"
#: Frames of 50 pixels or less, or hidden ones, by their own attributes; style sheets aren't read.
SMALL = r"""(?is)\s(?:width|height)\s*=\s*["']?(?:[0-9]|[1-4][0-9]|50)(?:px)?["'\s>]|\sstyle\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)"""
PAGE_STEP = r"^(?:next|previous|prev|page\s*[0-9]+|[0-9]+\s*of\s*[0-9]+|»|‹|›|«)$"
#: Required pages, by URL and by link text.
REQUIRED_PAGES = (
    ("about", "/about", "about|关于我们|关于"),
    ("privacy", "/privacy", "privacy|隐私"),
    ("contact", "/contact", "contact|联系"),
    ("terms", "/terms|/legal", "terms|legal|条款"),
)


def classed(names: str) -> str:
    """A pattern for a tag's class attribute that holds one of the names as a whole word."""
    held = lambda q: rf"{q}(?:[^{q}]*\s)?(?:{names})(?:\s[^{q}]*)?{q}"
    return rf"""\s(?i:class)\s*=\s*(?:{held('"')}|{held("'")})"""


def within(tag: str, attribute: str, pieces: str) -> str:
    """A pattern for a tag whose attribute holds one of the pieces."""
    return rf"""<(?i:{tag})(?:\s[^>]*)?\s(?i:{attribute})\s*=\s*(?:"[^"]*(?:{pieces})|'[^']*(?:{pieces}))"""


def equals(tag: str, attribute: str, values: str) -> str:
    """A pattern for a tag whose attribute is one of the values."""
    return rf"""<(?i:{tag})(?:\s[^>]*)?\s(?i:{attribute})\s*=\s*["'](?:{values})["']"""


ANY = "[a-z][a-z0-9]*"
LISTED = rf"^<(?i:article|figure)[\s>]|{classed(CARDS)}"
HAS_PAGINATION = "|".join((equals("a", "rel", "next|prev"), f"<(?i:{ANY})(?:\\s[^>]*)?{classed(PAGINATION)}", within("nav", "aria-label", "[Pp]age")))
HAS_CATEGORIES = "|".join((f"<(?i:{ANY})(?:\\s[^>]*)?{classed(GROUPS)}", within(ANY, "class", "category|filter|sort")))
HAS_SEARCH = "|".join((equals("input", "type", "(?i:search)"), equals(ANY, "role", "search"), within("form", "action", "search"), f"<(?i:{ANY})(?:\\s[^>]*)?{classed(SEARCH)}", equals("input", "name", "q|search|query")))
LANG = (r"""(?is)<html(?:\s[^>]*)?\slang\s*=\s*["']([^"']*)["']""", r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']content-language["'][^>]*content\s*=\s*["']([^"']*)["']""")
DESCRIPTION = r"""(?is)<meta\s[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*["']([^"']*)["']"""
OG_DESCRIPTION = r"""(?is)<meta\s[^>]*property\s*=\s*["']og:description["'][^>]*content\s*=\s*["']([^"']*)["']"""


def _plain(markup: Column) -> Column:
    return T.trimmed(T.decoded(F.regexp_replace(markup, "<[^>]*>", "")))


def nav_text(html: Column) -> Column:
    return _plain(F.regexp_extract(html, "(?is)<nav[^>]*>(.*?)</nav>", 1))


def h1_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<h1[\s>]")).cast("long")


def has_viewport(html: Column) -> Column:
    return html.rlike(r"""(?i)<meta\s[^>]*name\s*=\s*["']viewport["']""")


def language(html: Column) -> Column:
    """The page's language, else the header's, else en; empty stays empty."""
    return F.when(html.rlike(LANG[0]), F.regexp_extract(html, LANG[0], 1)).when(html.rlike(LANG[1]), F.regexp_extract(html, LANG[1], 1)).otherwise("en")


def heading_levels(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s>]"), F.lit(1)), lambda x: x.cast("int"))


def skips(levels: Column, sign: int) -> Column:
    """Whether a level falls (sign 1) or rises (sign -1) by more than one from a heading to the next."""

    def of(own: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda i: (F.element_at(own, i) - F.element_at(own, i + 1)) * sign)
        return F.when(F.size(own) > 1, F.exists(steps, lambda d: d > 1)).otherwise(F.lit(False))

    # transform() of one row: the levels are read once, not again for each of them
    return F.transform(F.array(levels), of)[0]


def page_text(pages: DataFrame) -> DataFrame:
    """site, page_id, url, text. Narrow: markup is dropped here, so it never reaches a shuffle."""
    return pages.select("site", "page_id", "url", T.visible(F.col("html")).alias("text"))


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, descriptions, language (the page's, else the header's, else en; empty stays empty), first menu and footer, and level-one headings."""
    html = F.col("html")
    heads = F.transform(F.regexp_extract_all(html, F.lit("(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>"), F.lit(1)), lambda x: _plain(x))
    return pages.select(
        "site",
        "page_id",
        _plain(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(html, DESCRIPTION, 1).alias("description"),
        F.regexp_extract(html, OG_DESCRIPTION, 1).alias("og_description"),
        language(html).alias("lang"),
        nav_text(html).alias("nav_text"),
        _plain(F.regexp_extract(html, "(?is)<footer[^>]*>(.*?)</footer>", 1)).alias("footer_text"),
        F.array_join(heads, " ").alias("h1_text"),
        h1_count(html).alias("h1_count"),
    )


def resolved(raw: Column, url: Column) -> Column:
    """A link's address from its page's, as browsers resolve it; tabs and line breaks in it are nothing."""
    raw = F.regexp_replace(T.trimmed(raw), r"[\t\n\r]", "")
    bare = F.regexp_replace(url, "[?#].*$", "")
    folder = F.when(urls.path(bare).contains("/"), F.regexp_extract(bare, "^(.*/)", 1)).otherwise(F.concat(bare, F.lit("/")))
    out = F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), raw).when(raw.startswith("//"), F.concat(F.regexp_extract(url, "^([^/]*)", 1), raw)).when(raw.startswith("/"), F.concat(urls.origin(url), raw))
    out = out.when((raw == "") | raw.startswith("#"), F.concat(F.regexp_replace(url, "#.*$", ""), raw)).when(raw.startswith("?"), F.concat(bare, raw))
    return urls.canonical(out.otherwise(F.concat(folder, raw)))


def anchors(html: Column) -> Column:
    """(h, a) of each link in order: its address as written and its markup. Markup is searched once; a link's parts are read from the link."""
    part = lambda link, k: F.regexp_extract(link, ANCHOR, k)
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda x: F.struct(F.concat(part(x, 1), part(x, 2), part(x, 3)).alias("h"), part(x, 4).alias("a")))


def page_links(pages: DataFrame) -> DataFrame:
    """site, page_id, pos, href, anchor_text: links in order, resolved against the page; only http ones."""
    html = F.col("html")
    links = pages.select("site", "page_id", "url", F.posexplode(anchors(html)).alias("pos", "link"))
    # explode() of one row: the address is worked out once, not again in each filter on it
    links = links.select("site", "page_id", F.col("pos").cast("long").alias("pos"), "link.a", F.explode(F.array(resolved(F.col("link.h"), F.col("url")))).alias("href"))
    return links.where(F.col("href").rlike("^https?://")).select("site", "page_id", "pos", "href", _plain(F.col("a")).alias("anchor_text"))


def internal_links(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Per page: links, those within the site, and those that lead to content pages of it. links: page_links() of the pages, where they are at hand."""
    links = page_links(pages) if links is None else links
    p = urls.path(F.col("href"))
    same = urls.site(F.col("href")) == F.col("site")
    inside = same & urls.is_content(F.col("href")) & ~((p.isin("/", "")) & F.col("href").contains("?"))
    return links.groupBy("site", "page_id").agg(F.count("*").alias("n_links"), F.count_if(same).alias("n_same_site"), F.count_if(inside).alias("n_internal"), F.count_distinct(F.when(inside, F.col("href"))).alias("n_distinct"))


def content_urls(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Distinct content URLs that a site's pages link to."""
    links = page_links(pages) if links is None else links
    p = urls.path(F.col("href"))
    return links.where((urls.site(F.col("href")) == F.col("site")) & urls.is_content(F.col("href")) & ~((p.isin("/", "")) & F.col("href").contains("?"))).select("site", "href").distinct()


def page_signals(pages: DataFrame, *more: Column) -> DataFrame:
    """Counts and flags from which site types are told; frames count where they can be seen and are no adverts. more: further columns of pages."""
    html = F.col("html")
    own = lambda tag, name: F.nullif(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    source = lambda tag: F.coalesce(own(tag, "src"), own(tag, "data-src"), own(tag, "data-lazy-src"), F.lit(""))
    frames = F.filter(F.regexp_extract_all(html, F.lit(FRAME), F.lit(0)), lambda t: ~t.rlike(SMALL) & ~source(t).rlike(f"(?i){ADVERTS}"))
    sources = F.filter(F.transform(frames, lambda t: F.coalesce(F.nullif(source(t), F.lit("")), own(t, "data-lazyloaded-src"), F.lit(""))), lambda x: x != "")
    hrefs = F.transform(anchors(html), lambda x: resolved(x["h"], F.col("url")))
    number = lambda tag: F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]")).cast("long")
    listed = F.size(F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: t.rlike(LISTED))).cast("long")
    steps = F.exists(F.regexp_extract_all(html, F.lit(r"(?is)<a(?:\s[^>]*)?>(.*?)</a>"), F.lit(1)), lambda a: F.lower(_plain(a)).rlike(PAGE_STEP))
    return pages.select(
        "site",
        "page_id",
        sources.alias("iframe_srcs"),
        F.size(frames).cast("long").alias("iframes"),
        number("canvas").alias("canvases"),
        number("article").alias("articles"),
        number("video").alias("videos"),
        T.solid_length(T.visible(html)).alias("text_length"),
        F.size(F.filter(hrefs, lambda h: h.rlike("(?i)/(?:game|play|games)/"))).cast("long").alias("game_links"),
        F.when(listed > 0, listed).otherwise(number("li")).alias("list_items"),
        (html.rlike(HAS_PAGINATION) | steps).alias("has_pagination"),
        html.rlike(HAS_CATEGORIES).alias("has_categories"),
        html.rlike(HAS_SEARCH).alias("has_search"),
        has_viewport(html).alias("has_viewport"),
        *more,
    )


def headings(pages: DataFrame) -> DataFrame:
    """Per page: headings, and whether a level falls (or rises) by more than one from one to the next."""
    df = pages.select("site", "page_id", heading_levels(F.col("html")).alias("levels"))
    return df.select("site", "page_id", F.size("levels").cast("long").alias("n_headings"), skips(F.col("levels"), 1).alias("heading_skip"), skips(F.col("levels"), -1).alias("heading_skip_down"))


def required_pages(pages: DataFrame, sitemap: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """site, required, found_by, found_url: by each pattern of its address among the links in order, then in the sitemap (site, page_id, url), and only then by link texts."""
    hits = lambda value, pieces, by: [F.when(value.rlike(f"(?i){p}"), F.struct(F.lit(by == "text").alias("late"), F.lit(k).alias("k"), F.lit(by == "sitemap").alias("second"))) for k, p in enumerate(pieces)]

    def matches(df: DataFrame, url: Column, text: Column | None, by: str) -> DataFrame:
        rows = []
        for name, in_url, in_text in REQUIRED_PAGES:
            found = hits(url, in_url.split("|"), by) + (hits(text, in_text.split("|"), "text") if text is not None else [])
            rows.append(F.struct(F.lit(name).alias("required"), F.array_min(F.array(*found)).alias("rank")))
        return df.select("site", "page_id", "pos", url.alias("url"), F.explode(F.array(*rows)).alias("r")).where("r.rank is not null").select("site", "r.required", F.struct("r.rank", "page_id", "pos", "url").alias("hit"))

    found = matches(page_links(pages) if links is None else links, F.col("href"), F.col("anchor_text"), "url")
    if sitemap is not None:
        found = found.unionByName(matches(sitemap.withColumn("pos", F.lit(0).cast("long")), F.col("url"), None, "sitemap"))
    best = found.groupBy("site", "required").agg(F.min("hit").alias("hit"))
    all_ = pages.select("site").distinct().select("site", F.explode(F.array(*(F.lit(n) for n, _, _ in REQUIRED_PAGES))).alias("required"))
    by = F.when(F.col("hit").isNull(), "missing").when(F.col("hit.rank.late"), "text").when(F.col("hit.rank.second"), "sitemap").otherwise("url")
    return all_.join(best, ["site", "required"], "left").select("site", "required", by.alias("found_by"), F.col("hit.url").alias("found_url"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """The first page of each normal URL in a site."""
    first = Window.partitionBy("site", "norm_url").orderBy("page_id")
    return pages.select("site", "page_id", "url", urls.normalised(F.col("url")).alias("norm_url")).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def site_urls(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """site, norm_url, url, source, ordinal: addresses to crawl, the home page's content links in order, then the sitemap's, each normal form once.

    sitemap: site, page_id (its order), url. ordinal counts from 1 within a site.
    """
    home = pages.groupBy("site").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("h")).select("site", "h.*")
    linked = page_links(home).select("site", F.col("pos").alias("at"), F.col("href").alias("url"), F.lit(0).alias("from_sitemap"))
    listed = sitemap.select("site", F.col("page_id").alias("at"), "url", F.lit(1).alias("from_sitemap"))
    both = linked.unionByName(listed).where((urls.site(F.col("url")) == F.col("site")) & urls.is_content(F.col("url")) & ~(urls.path(F.col("url")).isin("/", "") & F.col("url").contains("?")))
    first = both.groupBy("site", urls.normalised(F.col("url")).alias("norm_url")).agg(F.min(F.struct("from_sitemap", "at", "url")).alias("f")).select("site", "norm_url", "f.*")
    ordered = ranking.ranked(first, ["site"], [F.asc("from_sitemap"), F.asc("at"), F.asc("norm_url")], "ordinal")
    return ordered.select("site", "norm_url", "url", F.when(F.col("from_sitemap") == 1, "sitemap").otherwise("link").alias("source"), "ordinal")


def site_pages(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Pages of a site: distinct normal URLs crawled or linked."""
    all_ = pages.select("site", urls.normalised(F.col("url")).alias("u")).unionByName(content_urls(pages, links).select("site", urls.normalised(F.col("href")).alias("u"))).distinct()
    n = F.count("*")
    return all_.groupBy("site").agg(n.alias("n_urls")).withColumn("status", F.when(F.col("n_urls") < 10, "warn").otherwise("pass"))


def robots_sitemaps(resources: DataFrame) -> DataFrame:
    """site, sitemap: from the lines of robots.txt."""
    lines = resources.select("site", F.explode(F.split("robots_txt", "\n")).alias("line"))
    found = F.regexp_extract(F.trim(F.regexp_replace("line", "\r", "")), r"(?i)^sitemap:\s*(\S+)", 1)
    return lines.select("site", found.alias("sitemap")).where("sitemap <> ''").distinct()


def sitemap_urls(roots: DataFrame, files: DataFrame, deepest: int = 3) -> DataFrame:
    """site, url: pages of sitemaps, following indexes down to a depth; each file is read once per site.

    roots: site, sitemap. files: sitemap, xml. Sitemaps that an index at the limit names are dropped.
    """
    todo, seen, out = roots.select("site", F.regexp_replace("sitemap", "/+$", "").alias("sitemap")).distinct(), None, None
    files = files.select(F.regexp_replace("sitemap", "/+$", "").alias("sitemap"), "xml")
    for depth in range(deepest + 1):
        got = todo.join(files, "sitemap")
        index = F.col("xml").rlike("(?i)<sitemap[\\s>]")
        locs = got.select("site", index.alias("index"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).where(F.col("url").rlike("^https?://"))
        pages = locs.where("not index").select("site", "url")
        out = pages if out is None else out.unionByName(pages)
        if depth == deepest:
            break
        seen = todo if seen is None else seen.unionByName(todo)
        todo = locs.where("index").select("site", F.regexp_replace("url", "/+$", "").alias("sitemap")).distinct().join(seen, ["site", "sitemap"], "left_anti")
    return out.distinct()


def split_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alive, dead) responses: a status of 400 or more, or none, is dead; dead rows say why."""
    dead = F.coalesce(F.col("status") >= 400, F.lit(True))
    return responses.where(~dead), responses.where(dead).withColumn("reason", F.coalesce(F.col("status").cast("string"), F.lit("timeout")))
