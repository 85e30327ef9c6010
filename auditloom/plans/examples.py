"""Fixed rows for what the crawl tables hold no case of."""

from __future__ import annotations

URLS = ["/", "/about-us", "/ja/privacy", "/blog/about-x", "/search", "/en/login", "/blog/a", "/ja/blog/my-post", "/games/x", "/watch/1", "/wiki/Topic", "/wiki", "/archive", "/ja/wiki", "/blog", "/ja", "/ja/games", "/tv", "/ja/categories", "/en/825", "/Blog/x", "/docs/", "/ja/docs/intro", "/ABOUT"]
PATHS = ["/2024/x", "/2025/01/x", "/2025-01-03-x", "/x", "/2024/05/25", "/2024/12/25", "/2023/2/30", "/2019/7", "/a/2021/11/9/b", "/2031/x"]
TEXTS = ["Updated 2025-03-14 and 2024/1/2.", "On March 5, 2025 we met; again 12 Jan 2024.", "January 2023 issue", "2024-02-31 is no day", "nothing", "2026-12-01 lies ahead, 2019-05-05 is too old", "2025年4月1日 更新", "3 Sept 2024 and May 2025"]
REPLIES = [
    ("fr", '{"evaluation_details": {"value": 8, "originality": 7, "relevance": 9, "compliance": 10, "translation": 10}, "confidence": "high"}'),
    ("fr", 'Here: {"value": 8, "originality": 7, "relevance": 9, "compliance": 10, "translation": 10} done'),
    ("fr", '{"value": 8, "originality": 7, "relevance": 9, "compliance": 10, "translation": 10, "confidence": "low"}'),
    ("fr", '{"value": 0, "originality": 7, "relevance": 9, "compliance": 10, "translation": 10, "confidence": "medium"}'),
    ("fr", '{"value": 3, "originality": 3, "relevance": 3, "compliance": 6, "translation": 3, "pageType": "required"}'),
    ("en", '{"value": 6, "originality": 6, "relevance": 6, "compliance": 9, "translation": 2}'),
    ("en-US", '{"value": 6, "originality": 6, "relevance": 6, "compliance": 9, "translation": 2}'),
    ("fr", '{"value": "abc", "originality": 12, "relevance": -3, "compliance": null, "translation": 7.5}'),
    ("fr", "no object here"),
    ("EN", '{"value": 8, "originality": 8, "relevance": 6, "compliance": 9, "translation": 2, "confidence": "Low", "pageType": "unknown"}'),
    ("", '{"value": 8, "originality": 8, "relevance": 6, "compliance": 9, "translation": 2, "confidence": "certain", "pageType": "utility"}'),
    ("", '{"value": 8, "originality": 8, "relevance": 6, "compliance": 9, "translation": 2, "pageType": "reference_listing"}'),
    ("fr", '{"value": 10, "originality": 10, "relevance": 10, "compliance": 0, "translation": 10}'),
]
REPLIES += [("fr", 'So: {"evaluation_details": {"value": 6, "relevance": 5, "value_reason": "thin"}, "relevanceLabel": "close", "assessment": "so so", "suggestions": ["write more", "cite"]}'), ("fr", '{"value": 6, "relevance": 5, "value_reason": "flat"}')]
TOPICS = [
    ("a.example", '{"type": "game", "topic": "Chess", "description": "d", "confidence": "high", "isYMYL": true, "nicheFocusScore": 14}'),
    ("b.example", 'Well: {"type": "shop", "nicheFocusScore": 0, "isYMYL": false}'),
    ("c.example", '{"topic": "T", "nicheFocusScore": "7"}'),
    ("d.example", "no idea"),
]
SUMMARIES = ['{"probability": 130, "verdict": "v", "analysis": "a", "reasons": ["r", "s"], "topActions": [], "detailedSummary": "x"}', 'hm {"probability": "-4"} hm', '{"verdict": "only"}', "none"]
RESOURCES = [("a.example", True, "Sitemap: https://a.example/s.xml", False, True), ("b.example", True, "Allow: /", False, False), ("c.example", False, "sitemap: x", True, None), ("d.example", True, "x\n  SITEMAP: y", None, True)]
RESPONSES = [("a.example", "u1", 404), ("a.example", "u2", None), ("a.example", "u3", 200), ("b.example", "u4", 500), ("c.example", "u5", 399)]
HOME_LINKS = [("a.example", 10, 6), ("b.example", 6, 6), ("c.example", 4, 4), ("d.example", 0, 0)]
METAS = [
    ("a.example", "A long title", "A description that is longer than twenty characters and, with all that is said here, longer than a hundred of them.", "", "Head", "Tools | About"),
    ("b.example", "Title", "", "Twenty-one characters here, and more", "Head", "Wiki"),
    ("c.example", "A long title", "", "Twenty-one characters here", "Head", "Wiki"),
    ("d.example", "", "A description that is longer than twenty characters and, with all that is said here, longer than a hundred of them.", "", "Head", "Home"),
    ("e.example", "", "", "", "", ""),
]
COMPOSITES = [(97, 94, 90, 10, 10), (97, 94, 90, 5, 10), (97, 94, 90, 10, 5), (None, 80, 60, 10, 10)]
APPROVALS = [(82, "ready", 70, 6, 10, 12), (40, "fail", 30, 3, 60, 3), (60, "warn", 0, 5, 30, 7), (75, "ready", 45, 9, 50, 10)]
ROBOTS = [("a.example", "User-agent: *\nSitemap: https://a.example/s.xml\nsitemap:https://a.example/i.xml/"), ("b.example", "Disallow: /"), ("c.example", "SITEMAP: https://c.example/deep0.xml\r\nAllow: /")]
SITEMAPS = [
    ("https://a.example/s.xml", "<urlset><url><loc>https://a.example/1</loc></url><url><loc> https://a.example/2 </loc></url><url><loc>ftp://a.example/3</loc></url></urlset>"),
    ("https://a.example/i.xml", "<sitemapindex><sitemap><loc>https://a.example/s.xml/</loc></sitemap><sitemap><loc>https://a.example/t.xml</loc></sitemap></sitemapindex>"),
    ("https://a.example/t.xml", "<urlset><url><loc>https://a.example/9</loc></url></urlset>"),
    *((f"https://c.example/deep{k}.xml", f"<sitemapindex><sitemap><loc>https://c.example/deep{k + 1}.xml</loc></sitemap></sitemapindex>") for k in range(3)),
    ("https://c.example/deep3.xml", "<urlset><url><loc>https://c.example/end</loc></url></urlset>"),
]
SUGGESTIONS = ["Add an about page so that readers know who writes here", "Add an about page so that readers know who writes here, soon", "Write longer articles", "Write longer articles", "Fix links"]
#: Number of the first page below; the crawl has none as high.
CASES = 10**12
PAGES = [
    ("", "<html lang=\"\"><head><title> A &amp; B </title><meta name=\"description\" content=\"d\"></head><body><h1>One</h1><h1>Two</h1><a href=\"x\">x</a></body></html>"),
    ("/a/b?q=1#f", "<html><head><meta http-equiv=\"Content-Language\" content=\"fr\"><meta property=\"og:description\" content=\"og\"></head><a href=\"c\">c</a><a href=\"?r\">r</a><a href=\"#s\">s</a><a href=\"./games/t\">t</a><a href=\"//other.example/GAME/u\">u</a><a href=\"/v\"> Page 2 </a><a href=\"mailto:w\">w</a></html>"),
    ("/frames", "<iframe></iframe><iframe data-src=\"https://g.example/embed\" src=\"https://f.example/1\"></iframe><iframe src=\"https://ad.doubleclick.net/x\"></iframe><iframe width=\"50\" src=\"https://s.example/\"></iframe><iframe width=51 data-lazyloaded-src=\"https://l.example/\"></iframe><iframe style=\"display: none\" src=\"https://h.example/\"></iframe>"),
    ("/list", "<article><p class=\"a card b\">1</p></article><figure>2</figure><div class=\"cards discard\">3</div><ul><li>4</li></ul><div class=\"tag-list\"></div><form action=\"/search\"></form>"),
    ("/items", "<ul><li>1</li><li>2</li></ul><a rel=\"prev\" href=\"/1\">back</a><div class=\"my-filter\"></div><input name=\"q\">"),
    ("/more", "<nav aria-label=\"Pages\"></nav><div class='genres'></div><div role=\"search\"></div>"),
    ("/class", "<div class=\"x page-nav\"></div><div class=\"x-pagination\"></div><div class=\"search-box\"></div>"),
    ("/next", "<a>\u00bb</a><input type=\"SEARCH\">"),
    ("/none", "<a href=\"/n\">nextly</a><input type=\"text\" name=\"quest\"><div class=\"pages searching\" data-rel=\"next\"></div>"),
    ("/styles", "<style>/* p{font-size:1px} */ p, .small.x { font-size: 11px } #big{font-size:2em} .tiny{FONT-SIZE:8pt;display:block} @media print { .gone { display : none } } div .deep{display:none}</style><!-- <p>no</p> --><p>a</p><p id='big'>b</p><p class='tiny'>c</p><p style='font-size: 12px'>d</p><span class=\"tiny\">e</span><a class='none'>f</a>"),
    ("/covers", "<style>.hide{display:none}.modal-x{opacity:0}#popup2{visibility:hidden}div.modal{opacity:1}iframe.small{width:40px}</style><div class='modal'></div><div class='modal hide'></div><div class='modal-x'></div><div id='popup1'></div><div id='popup2'></div><div id='overlay'></div><div class='my-overlay' style='opacity:0.5'></div><div class='popup' style='display:none'></div><iframe class='small'></iframe><iframe width=50></iframe><iframe width='51px' height='9%'></iframe><iframe class='hide'></iframe>"),
]
AS_OF = "2025-06-30"
