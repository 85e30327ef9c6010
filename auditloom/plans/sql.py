"""DuckDB SQL for the registered queries, written from their rules."""

from __future__ import annotations

from ..functions import text as T
from ..functions import urls as U
from ..operators import content, crawl, site_type
from . import derived as D
from . import examples as E

WS = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def q(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def decoded(x: str) -> str:
    for a, b in T.REFERENCES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def visible(x: str) -> str:
    for pattern, by in T.MARKUP:
        x = f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"
    return decoded(x)


def trimmed(x: str) -> str:
    return replaced(x, f"^{WS}+|{WS}+$", "")


def solid(x: str) -> str:
    return f"CAST(length({replaced(x, WS + '+', '')}) AS BIGINT)"


def plain(x: str) -> str:
    return trimmed(decoded(replaced(x, "<[^>]*>", "")))


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pattern)})) AS BIGINT)"


def near(x: str) -> str:
    """To the nearest whole number, halves up."""
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def values(rows: list, names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else q(v)
    numbered = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(rows)]
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in numbered)}) AS v({names}))"


CRAWL = "(SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS site, page_id, url, coalesce(html, '') AS html FROM pages)"


def made(text: str) -> str:
    """Rows that a text of derived.py makes of the crawl."""
    return text.format(pages=CRAWL, links="links")


def beside(text: str, rows: list, names: str, fixed: str = "k") -> str:
    """Derived rows and fixed ones, the latter numbered in the column `fixed`."""
    columns = [c.strip() for c in names.split(",")]
    return f"(SELECT {', '.join(columns)} FROM ({made(text)}) AS made_ UNION ALL SELECT {', '.join(columns)} FROM {values(rows, names if fixed in columns else fixed + ', ' + names)})"


def path_of(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def host_of(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def is_content(x: str) -> str:
    p = path_of(x)
    return f"({host_of(x)} <> '' AND NOT regexp_matches({p}, {q(rf'(?i)\.(?:{U.STATIC})$')}) AND NOT regexp_matches({p}, {q(rf'(?i)^(?:{U.TECHNICAL})')}) AND NOT ({p} IN ('', '/') AND contains({x}, '?')))"


def page_type(p: str) -> str:
    t = f"CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/$', '') ELSE {p} END"
    rest = f"regexp_extract({t}, '^/[a-z]{{2}}(/.*)?$', 1)"
    lang = f"regexp_matches({t}, '^/[a-z]{{2}}(?:/|$)')"
    out = f"CASE WHEN {p} IN ('', '/') THEN 'homepage' WHEN regexp_matches({p}, {q('(?i)' + U.REQUIRED)}) THEN 'required' WHEN regexp_matches({p}, {q('(?i)' + U.UTILITY)}) THEN 'utility'"
    for kind, names in U.DETAIL.items():
        out += f" WHEN regexp_matches({t}, '^/(?:{names})/.') THEN '{kind}'"
    out += f" WHEN regexp_matches({t}, '^/(?:{U.DETAIL['reference_detail']})$') THEN 'reference_listing' WHEN regexp_matches({t}, '^/(?:{U.LISTING})$') THEN 'listing' WHEN {lang} AND {rest} = '' THEN 'listing'"
    for kind, names in U.DETAIL.items():
        out += f" WHEN {lang} AND regexp_matches({rest}, '^/(?:{names})/.') THEN '{kind}'"
    for kind, names in U.DETAIL.items():
        out += f" WHEN {lang} AND regexp_matches({rest}, '^/(?:{names})/?$') THEN '{'reference_listing' if kind == 'reference_detail' else 'listing'}'"
    return out + f" WHEN {lang} AND regexp_matches({rest}, {q('(?i)' + U.REQUIRED)}) THEN 'required' ELSE 'unknown' END"


def by_type(weights: dict, default: float) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in weights.items()) + f" ELSE {default} END"


def word(x: str, kind: str) -> str:
    en, zh = site_type.MENU[kind]
    return rf"(regexp_matches({x}, {q(rf'(?i)\b(?:{en})\b')}) OR regexp_matches({x}, {q(zh)}))"


ANCHOR = q(crawl.ANCHOR)
H1 = q(r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>")


def _own(tag: str, *names: str) -> str:
    """The first attribute of a tag that isn't empty."""
    return "coalesce(" + ", ".join(f"""nullif(regexp_extract({tag}, {q(rf'(?is)\s{n}' + r"""\s*=\s*["']([^"']*)["']""")}, 1), '')""" for n in names) + ", '')"


def canonical(x: str) -> str:
    """An http address with scheme and host in lower case, without default port and dot segments."""
    path = path_of(x)
    dots = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
    pieces = f"list_transform(string_split({path}, '/')[2:], lambda z: CASE WHEN lower(replace(lower(z), '%2e', '.')) IN ('.', '..') THEN replace(lower(z), '%2e', '.') ELSE z END)"
    ended = f"CASE WHEN regexp_matches({path}, '(?i)/(?:\\.|%2e){{1,2}}$') THEN list_concat({pieces}, ['']) ELSE {pieces} END"
    folded = f"'/' || array_to_string(list_reduce(list_transform({ended}, lambda z: [z]), lambda done, z: CASE WHEN z[1] = '..' THEN list_slice(done, 1, greatest(len(done) - 1, 0)) WHEN z[1] = '.' THEN done ELSE list_concat(done, z) END, CAST([] AS VARCHAR[])), '/')"
    host = rf"regexp_replace(lower(regexp_extract({x}, '^([A-Za-z]+://[^/?#]*)', 1)), '^(http://[^:]*):80$|^(https://[^:]*):443$', '\1\2')"
    return f"CASE WHEN regexp_matches({x}, '(?i)^https?://') THEN {host} || CASE WHEN {path} = '' THEN '/' WHEN regexp_matches({path}, {q(dots)}) THEN {folded} ELSE {path} END || regexp_extract({x}, '^[A-Za-z]+://[^?#]*(.*)$', 1) ELSE {x} END"


def joined(x: str) -> str:
    """A link's written address put to its page's, not yet canonical."""
    bare = "regexp_replace(url, '[?#].*$', '')"
    return f"""CASE WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {x} WHEN starts_with({x}, '//') THEN regexp_extract(url, '^([^/]*)', 1) || {x} WHEN starts_with({x}, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {x}
      WHEN {x} = '' OR starts_with({x}, '#') THEN regexp_replace(url, '#.*$', '') || {x} WHEN starts_with({x}, '?') THEN {bare} || {x}
      ELSE (CASE WHEN contains({path_of(bare)}, '/') THEN regexp_extract({bare}, '^(.*/)', 1) ELSE {bare} || '/' END) || {x} END"""


def written(x: str) -> str:
    return f"regexp_replace({trimmed(x)}, '[\\t\\n\\r]', '', 'g')"


def _anchor_hits(k: int) -> str:
    return f"regexp_extract_all(html, {ANCHOR}, {k})"


def _policy() -> str:
    parts = []
    for rule, words in content.BLACKLIST:
        pattern = f"({words})" if rule == "zh" else rf"(?i)\b({words})\b"
        parts.append(f"SELECT site, page_id, '{rule}' AS rule, lower(regexp_extract(text, {q(pattern)}, 1)) AS word, {solid('text')} > 200 AS long_page FROM texts WHERE regexp_matches(text, {q(pattern)})")
    return " UNION ALL ".join(parts)


#: Required pages: patterns of the address in order, then of the link's text. Written out, not taken from the operators.
ASKED = {"about": (["/about"], ["about", "关于我们", "关于"]), "privacy": (["/privacy"], ["privacy", "隐私"]), "contact": (["/contact"], ["contact", "联系"]), "terms": (["/terms", "/legal"], ["terms", "legal", "条款"])}


def _required() -> str:
    hits = []
    for name, (in_url, in_text) in ASKED.items():
        for k, x in enumerate(in_url):
            hits.append(f"SELECT site, '{name}' AS required, 'url' AS found_by, href AS found_url, 0 AS late, {k} AS k, 0 AS second, page_id, pos FROM links WHERE regexp_matches(href, '(?i){x}')")
            hits.append(f"SELECT site, '{name}', 'sitemap', url, 0, {k}, 1, page_id, 0 FROM p WHERE regexp_matches(url, '(?i){x}')")
        hits += [f"SELECT site, '{name}', 'text', href, 1, {k}, 0, page_id, pos FROM links WHERE regexp_matches(anchor_text, '(?i){x}')" for k, x in enumerate(in_text)]
    first = f"SELECT * FROM ({' UNION ALL '.join(hits)}) QUALIFY row_number() OVER (PARTITION BY site, required ORDER BY late, k, second, page_id, pos, found_url) = 1"
    names = ", ".join(f"('{n}')" for n in ASKED)
    return f"SELECT s.site, r.required, coalesce(h.found_by, 'missing') AS found_by, h.found_url FROM sites s CROSS JOIN (VALUES {names}) AS r(required) LEFT JOIN ({first}) h ON h.site = s.site AND h.required = r.required"


def _month(x: str) -> str:
    return f"CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({x}, 3))) + 2) // 3 AS INT)"


def _fresh(table: str, key: str, as_of: str) -> str:
    """The key's columns, the latest date in the text and whether it is recent."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    iso = q(r"([0-9]{4})[年/.-]([0-9]{1,2})[月/.-]([0-9]{1,2})")
    mdy = q(rf"(?i)({months})\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})")
    dmy = q(r"(?i)([0-9]{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[A-Za-z0-9_]*\s+([0-9]{4})")
    my = q(rf"(?i)({months})\s+([0-9]{{4}})")
    g = lambda p, k: f"unnest(regexp_extract_all(text, {p}, {k}))"
    parts = [f"SELECT {key}, {g(iso, 1)} AS y, CAST({g(iso, 2)} AS INT) AS m, {g(iso, 3)} AS d FROM {table}", f"SELECT {key}, {g(mdy, 3)}, {_month(g(mdy, 1))}, {g(mdy, 2)} FROM {table}", f"SELECT {key}, {g(dmy, 3)}, {_month(g(dmy, 2))}, {g(dmy, 1)} FROM {table}", f"SELECT {key}, {g(my, 2)}, {_month(g(my, 1))}, '1' FROM {table}"]
    return f"""WITH parts AS ({' UNION ALL '.join(parts)}), found AS (SELECT {key}, try_cast(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day FROM parts),
      best AS (SELECT {key}, max(day) AS latest FROM found WHERE day > DATE '2020-01-01' AND day <= DATE '{as_of}' GROUP BY {key})
      SELECT {key}, CAST(latest AS VARCHAR) AS latest, coalesce(DATE '{as_of}' - latest <= 180, false) AS recent FROM {table} LEFT JOIN best USING ({key})"""


def _dates() -> str:
    return f"WITH t AS (SELECT CAST(text_id AS BIGINT) AS text_id, text FROM (SELECT doc_id + 1000 AS text_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT text_id, text FROM {values(E.TEXTS, 'text_id, text')})) SELECT * FROM ({_fresh('t', 'text_id', E.AS_OF)})"


def _topics(meta: str) -> str:
    return f"""SELECT site, score AS meta_score, score < 2 AS meta_incomplete, CASE WHEN score < 2 THEN NULL WHEN regexp_matches(nav_text, '(?i)calc|convert|generator|tool|checker|builder') THEN 'tool' WHEN regexp_matches(nav_text, '(?i)wiki|glossary|encyclopedia|dictionary|reference|archive') THEN 'reference' ELSE 'content' END AS type,
      CASE WHEN score < 2 THEN NULL WHEN t <> '' THEN t WHEN h1_text <> '' THEN h1_text ELSE 'Unknown' END AS topic, CASE WHEN score < 2 THEN NULL WHEN d <> '' THEN left(d, 300) WHEN h1_text <> t THEN left(h1_text, 300) ELSE '' END AS description, CASE WHEN score < 2 THEN NULL WHEN t <> '' AND length(d) > 50 THEN 'high' ELSE 'medium' END AS confidence
      FROM (SELECT *, CAST(length(t) > 5 AS BIGINT) + CAST(length(d) > 20 AS BIGINT) + CAST(length(d) > 100 AS BIGINT) AS score FROM (SELECT site, nav_text, h1_text, {trimmed('title')} AS t, CASE WHEN description <> '' THEN description ELSE og_description END AS d FROM {meta} WHERE page_id IN (SELECT min(page_id) FROM {meta} GROUP BY site)))"""


def _factors(composite: str) -> str:
    """The estimate over columns h, a, o, l (low ratio), n."""
    c = composite
    return f"""CAST(greatest(0, least(100, 50 + CASE WHEN {c} >= 75 THEN 25 WHEN {c} >= 50 THEN 10 ELSE -15 END + CASE h WHEN 'ready' THEN 15 WHEN 'fail' THEN -25 ELSE -10 END + CASE WHEN a <= 0 THEN 0 WHEN a >= 60 THEN 10 WHEN a >= 40 THEN 5 ELSE -10 END
          + CASE WHEN o >= 6 THEN 5 WHEN o < 4 THEN -10 ELSE 0 END + CASE WHEN l >= 0.5 THEN -10 WHEN l < 0.2 THEN 5 ELSE 0 END)) AS BIGINT) AS probability, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence,
      concat_ws(', ', CASE WHEN {c} >= 75 THEN 'composite_high' WHEN {c} >= 50 THEN 'composite_mid' ELSE 'composite_low' END, CASE h WHEN 'ready' THEN 'hard_ready' WHEN 'fail' THEN 'hard_fail' ELSE 'hard_warn' END, CASE WHEN a >= 60 THEN 'ai_high' WHEN a > 0 AND a < 40 THEN 'ai_low' END, CASE WHEN o < 4 THEN 'originality_low' END, CASE WHEN l >= 0.5 THEN 'many_low' END) AS factors"""


DIMS = ("value", "originality", "relevance", "compliance", "translation")
_signal = lambda tag: count("html", rf"(?i)<{tag}[\s>]")
_match = lambda pattern: f"regexp_matches(html, {q(pattern)})"

PARTS = {
    "p": f"SELECT {host_of('url')} AS site, page_id, url, coalesce(html, '') AS html FROM pages",
    "sites": "SELECT DISTINCT site FROM p",
    "home": "SELECT site, min(page_id) AS page_id FROM p GROUP BY site",
    "texts": f"SELECT site, page_id, url, {visible('html')} AS text FROM p",
    "meta": f"""SELECT site, page_id, {plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
      regexp_extract(html, {q(crawl.DESCRIPTION)}, 1) AS description, regexp_extract(html, {q(crawl.OG_DESCRIPTION)}, 1) AS og_description,
      CASE WHEN {_match(crawl.LANG[0])} THEN regexp_extract(html, {q(crawl.LANG[0])}, 1) WHEN {_match(crawl.LANG[1])} THEN regexp_extract(html, {q(crawl.LANG[1])}, 1) ELSE 'en' END AS lang,
      {plain("regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1)")} AS nav_text, {plain("regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1)")} AS footer_text,
      array_to_string(list_transform(regexp_extract_all(html, {H1}, 1), lambda x: {plain('x')}), ' ') AS h1_text, {_signal('h1')} AS h1_count FROM p""",
    "anchor_rows": f"SELECT site, page_id, url, unnest(list_zip({_anchor_hits(1)}, {_anchor_hits(2)}, {_anchor_hits(3)}, {_anchor_hits(4)})) AS l, unnest(range(len({_anchor_hits(4)}))) AS pos FROM p",
    "raw_links": f"SELECT site, page_id, url, pos, {written('concat(l[1], l[2], l[3])')} AS raw, l[4] AS inner_html FROM anchor_rows",
    "joined_links": f"SELECT site, page_id, pos, {joined('raw')} AS whole, inner_html FROM raw_links",
    "all_links": f"SELECT site, page_id, pos, {canonical('whole')} AS href, {plain('inner_html')} AS anchor_text FROM joined_links",
    "links": "SELECT * FROM all_links WHERE regexp_matches(href, '^https?://')",
    "internal": f"SELECT site, page_id, count(*) AS n_links, count(*) FILTER (same) AS n_same_site, count(*) FILTER (inside) AS n_internal, count(DISTINCT href) FILTER (inside) AS n_distinct FROM (SELECT *, {host_of('href')} = site AS same, {host_of('href')} = site AND {is_content('href')} AS inside FROM links) GROUP BY site, page_id",
    "content_links": f"SELECT DISTINCT site, href FROM links WHERE {host_of('href')} = site AND {is_content('href')}",
    "signals": f"""SELECT site, page_id, CAST(len(f) AS BIGINT) AS iframes, list_filter(list_transform(f, lambda x: {_own('x', 'src', 'data-src', 'data-lazy-src', 'data-lazyloaded-src')}), lambda x: x <> '') AS f, {_signal('canvas')} AS canvases, {_signal('article')} AS articles, {_signal('video')} AS videos, {solid(visible('html'))} AS text_length,
      CAST((SELECT count(*) FROM all_links a WHERE a.page_id = page_rows.page_id AND a.site = page_rows.site AND regexp_matches(a.href, '(?i)/(?:game|play|games)/')) AS BIGINT) AS game_links, CASE WHEN n > 0 THEN n ELSE {_signal('li')} END AS list_items,
      {_match(crawl.HAS_PAGINATION)} OR len(list_filter(regexp_extract_all(html, '(?is)<a(?:\\s[^>]*)?>(.*?)</a>', 1), lambda a: regexp_matches(lower({plain('a')}), {q(crawl.PAGE_STEP)}))) > 0 AS has_pagination, {_match(crawl.HAS_CATEGORIES)} AS has_categories,
      {_match(crawl.HAS_SEARCH)} AS has_search, {_match(r'''(?i)<meta\s[^>]*name\s*=\s*["']viewport["']''')} AS has_viewport
      FROM (SELECT *, list_filter(regexp_extract_all(html, {q(crawl.FRAME)}), lambda x: NOT regexp_matches(x, {q(crawl.SMALL)}) AND NOT regexp_matches({_own('x', 'src', 'data-src', 'data-lazy-src')}, {q('(?i)' + crawl.ADVERTS)})) AS f, CAST(len(list_filter(regexp_extract_all(html, {q(crawl.TAG)}), lambda x: regexp_matches(x, {q(crawl.LISTED)}))) AS BIGINT) AS n FROM p) page_rows""",
    "nodes": "SELECT site, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS norm_url, min(page_id) AS page_id FROM p GROUP BY 1, 2",
    "hops": "SELECT DISTINCT n.site, n.norm_url AS source, regexp_replace(regexp_replace(c.href, '#.*$', ''), '/+$', '') AS target FROM links c JOIN nodes n ON n.page_id = c.page_id JOIN content_links k ON k.site = c.site AND k.href = c.href",
    "walks": "SELECT site, norm_url, 0 AS depth FROM nodes QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1 UNION SELECT w.site, n.norm_url, w.depth + 1 FROM walks w JOIN hops h ON h.site = w.site AND h.source = w.norm_url JOIN nodes n ON n.site = h.site AND n.norm_url = h.target WHERE w.depth < 400",
    "depths": "SELECT n.site, n.page_id, n.norm_url, CAST(w.depth AS BIGINT) AS depth FROM nodes n LEFT JOIN (SELECT site, norm_url, min(depth) AS depth FROM walks GROUP BY 1, 2) w USING (site, norm_url)",
    "heads": r"""SELECT site, page_id, CAST(len(v) AS BIGINT) AS n_headings, len(list_filter(range(1, len(v)), lambda i: v[i] - v[i + 1] > 1)) > 0 AS heading_skip, len(list_filter(range(1, len(v)), lambda i: v[i + 1] - v[i] > 1)) > 0 AS heading_skip_down
      FROM (SELECT site, page_id, list_transform(regexp_extract_all(html, '(?i)<h([1-6])[\s>]', 1), lambda x: CAST(x AS INT)) AS v FROM p)""",
    "required": _required(),
    "paras": f"SELECT site, page_id, text, k, {trimmed('u')} AS para FROM (SELECT site, page_id, text, unnest(s) AS u, unnest(range(len(s))) AS k FROM (SELECT *, regexp_split_to_array(text, '\\n\\s*\\n') AS s FROM texts))",
    "norm_texts": f"SELECT site, page_id, text, {replaced('text', WS + '+', ' ')} AS body FROM texts",
    "para_counts": f"""SELECT a.site, a.page_id, a.k, a.para, count(b.page_id) AS others, count(b.page_id) FILTER (contains(b.body, left({replaced('a.para', WS + '+', ' ')}, 100))) AS held, (SELECT count(*) FROM texts t WHERE t.site = a.site) AS n
      FROM paras a LEFT JOIN norm_texts b ON a.site = b.site AND a.text <> b.text WHERE a.para <> '' GROUP BY a.site, a.page_id, a.k, a.para""",
    "main": "SELECT t.site, t.page_id, t.text, coalesce(m.main_text, '') AS main_text FROM texts t LEFT JOIN (SELECT page_id, string_agg(para, chr(10) || chr(10) ORDER BY k) AS main_text FROM para_counts WHERE n <= 1 OR length(para) < 20 OR held < ceil(others * 0.6) GROUP BY page_id) m USING (page_id)",
    "ratio": f"SELECT site, page_id, a AS total_length, b AS main_length, CAST(CASE WHEN a > 0 THEN floor(b * 100 / a + 0.5) ELSE 0 END AS BIGINT) AS ratio_percent FROM (SELECT site, page_id, {solid('text')} AS a, {solid('main_text')} AS b FROM main)",
    "ratio_sites": """SELECT site, n_low, CASE WHEN n_low > 0 THEN 'fail' ELSE 'pass' END AS ratio_status, n_sub, n_thin, CASE WHEN n_thin = 0 THEN 'pass' WHEN n_thin * 2 > n_sub THEN 'fail' ELSE 'warn' END AS depth_status
      FROM (SELECT r.site, count(*) FILTER (main_length / greatest(total_length, 1) < 0.3 AND total_length > 200) AS n_low, count(*) FILTER (r.page_id <> h.page_id) AS n_sub, count(*) FILTER (r.page_id <> h.page_id AND main_length < 300) AS n_thin FROM ratio r JOIN home h USING (site) GROUP BY r.site)""",
    "words": f"SELECT site, page_id, list_filter(regexp_split_to_array(lower(main_text), {q(WS + '+')}), lambda w: length(w) > 1) AS w FROM main",
    "gram_lists": "SELECT site, page_id, CASE WHEN len(w) < 4 THEN w ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS g FROM words",
    "grams": "SELECT site, page_id, len(list_distinct(g)) AS n, unnest(list_distinct(g)) AS gram FROM gram_lists WHERE len(g) >= 3",
    "alike": "SELECT a.site, a.page_id AS a, b.page_id AS b, count(*) / (a.n + b.n - count(*)) AS similarity FROM grams a JOIN grams b ON a.site = b.site AND a.gram = b.gram AND a.page_id < b.page_id GROUP BY a.site, a.page_id, b.page_id, a.n, b.n",
    "jaccard": "SELECT site, a, b, round(similarity, 6) AS similarity FROM alike",
    "dup": f"SELECT site, round(m, 6) AS max_similarity, CAST(greatest(0, least(100, {near('(1 - m) * 100')})) AS BIGINT) AS originality_score, CASE WHEN floor(m * 100 + 0.5) >= 60 THEN 'warn' ELSE 'pass' END AS status, a AS page_a, b AS page_b FROM (SELECT s.site, a, b, coalesce(similarity, 0.0::DOUBLE) AS m FROM sites s LEFT JOIN (SELECT * FROM alike QUALIFY row_number() OVER (PARTITION BY site ORDER BY similarity DESC, a, b) = 1) USING (site))",
    "skeletons": f"SELECT site, page_id, left({replaced(replaced(replaced('text', '[a-zA-Z一-鿿]+', 'W'), '[0-9]+', 'N'), WS + '+', ' ')}, 1000) AS s FROM texts",
    "templates": """SELECT * FROM (SELECT a.site, a.page_id AS a, b.page_id AS b, round(len(list_filter(range(1, least(length(a.s), length(b.s)) + 1), lambda i: substr(a.s, i, 1) = substr(b.s, i, 1))) / greatest(length(a.s), length(b.s)), 6) AS similarity
      FROM skeletons a JOIN skeletons b ON a.site = b.site AND a.page_id < b.page_id WHERE a.s <> '' AND b.s <> '') WHERE similarity >= 0.6""",
    "ties": "SELECT a, b FROM templates UNION ALL SELECT b, a FROM templates",
    "reach": "SELECT page_id AS node, page_id AS root FROM p UNION SELECT t.b, r.root FROM reach r JOIN ties t ON t.a = r.node",
    "clusters": """SELECT site, m AS max_similarity, CAST(size AS BIGINT) AS cluster_size, m > 0.6 AND size >= 3 AS is_template FROM (SELECT site, max(c) AS size, sum(c) AS n FROM (SELECT p.site, r.root, count(*) AS c FROM p JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = p.page_id GROUP BY p.site, r.root) GROUP BY site)
      JOIN (SELECT s.site, coalesce(max(similarity), 0.0::DOUBLE) AS m FROM sites s LEFT JOIN templates USING (site) GROUP BY s.site) USING (site) WHERE n >= 3""",
    "hits": _policy(),
    "verdict": "SELECT s.site, count(h.rule) AS n_hits, CASE WHEN count(h.rule) = 0 THEN 'pass' WHEN bool_and(h.long_page) THEN 'warn' ELSE 'fail' END AS status FROM sites s LEFT JOIN hits h USING (site) GROUP BY s.site",
    "features": f"""SELECT g.site, count(*) AS n_pages, avg(CAST(vf > 0 AS INT)) AS vfs, avg(CAST(videos > 0 AS INT)) AS vs, avg(CAST(gf > 0 AS INT)) AS gfs, avg(CAST(iframes > 0 AS INT)) AS fs, avg(CAST(canvases > 0 AS INT)) AS cs, avg(CAST(articles > 0 AS INT)) AS ars,
      avg(game_links) AS gl, sum(game_links) AS agl, arg_min(vf, g.page_id) AS hvf, arg_min(iframes, g.page_id) AS hf, arg_min(canvases, g.page_id) AS hc, arg_min(m.nav_text || ' ' || m.footer_text, g.page_id) AS menu
      FROM (SELECT *, len(list_filter(f, lambda x: regexp_matches(x, {q('(?i)' + site_type.VIDEO_FRAMES)}))) AS vf, len(list_filter(f, lambda x: regexp_matches(x, {q('(?i)' + site_type.GAME_FRAMES)}))) AS gf FROM signals) g JOIN meta m USING (page_id) GROUP BY g.site""",
    "points": f"""SELECT *, CASE WHEN vfs >= 0.3 THEN 5 WHEN vfs >= 0.1 THEN 3 ELSE 0 END + CASE WHEN vs >= 0.3 THEN 5 WHEN vs >= 0.1 THEN 3 ELSE 0 END + CASE WHEN {word('menu', 'video')} THEN 3 ELSE 0 END + CASE WHEN hvf >= 3 THEN 3 WHEN hvf >= 1 THEN 1 ELSE 0 END AS video_points,
      CASE WHEN gfs >= 0.3 THEN 5 WHEN gfs >= 0.1 THEN 3 ELSE 0 END + CASE WHEN fs >= 0.3 THEN 2 WHEN hf >= 1 THEN 1 ELSE 0 END + CASE WHEN cs >= 0.1 THEN 4 ELSE 0 END + CASE WHEN hc >= 1 THEN 3 ELSE 0 END + CASE WHEN {word('menu', 'game')} THEN 3 ELSE 0 END + CASE WHEN hf >= 3 THEN 3 ELSE 0 END
      + CASE WHEN gl >= 5 THEN 3 WHEN gl >= 2 THEN 2 WHEN agl >= 3 THEN 1 ELSE 0 END AS g0, CASE WHEN ars >= 0.7 THEN 3 WHEN ars >= 0.5 THEN 1 ELSE 0 END + CASE WHEN {word('menu', 'reference')} THEN 3 ELSE 0 END + CASE WHEN fs < 0.1 THEN 1 ELSE 0 END AS reference_points, {word('menu', 'tool')} AS tool FROM features""",
    "types": """SELECT site, n_pages, CASE WHEN video_points >= 3 THEN 'video' WHEN game_points >= 3 THEN 'game' WHEN tool THEN 'tool' WHEN reference_points >= 3 THEN 'reference' ELSE 'content' END AS type,
      CASE WHEN video_points >= 6 THEN 'high' WHEN video_points >= 3 THEN 'medium' WHEN game_points >= 6 THEN 'high' WHEN game_points >= 3 OR tool THEN 'medium' WHEN reference_points >= 6 THEN 'high' WHEN reference_points >= 3 THEN 'medium' ELSE 'high' END AS confidence,
      CAST(video_points AS BIGINT) AS video_points, CAST(game_points AS BIGINT) AS game_points, CAST(reference_points AS BIGINT) AS reference_points FROM (SELECT *, g0 - CASE WHEN ars >= 0.7 AND g0 < 3 THEN 2 ELSE 0 END AS game_points FROM points)""",
    "plain": "SELECT site FROM types WHERE type NOT IN ('game', 'video', 'reference')",
    "scale": r"SELECT site, count(*) AS n_urls, CASE WHEN count(*) < 10 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT site, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS u FROM p UNION SELECT site, regexp_replace(regexp_replace(href, '#.*$', ''), '/+$', '') FROM content_links) GROUP BY site",
    "scored": f"SELECT site, p.page_id, {page_type(path_of('url'))} AS type, CAST(3 + 5 * quality AS BIGINT) AS value, CAST(CASE WHEN quality IS NOT NULL THEN 4 + p.page_id % 6 END AS BIGINT) AS originality, CAST(CASE WHEN quality IS NOT NULL THEN 5 + p.page_id % 5 END AS BIGINT) AS relevance, CAST(10 - 8 * toxic AS BIGINT) AS compliance, CAST(CASE WHEN quality IS NOT NULL THEN 6 + p.page_id % 4 END AS BIGINT) AS translation FROM p LEFT JOIN labels ON doc_id = p.page_id",
    "page_scores": f"SELECT site, page_id, type, relevance, compliance, quality_known, {near('pow(v * o * r * c * t, 0.2) * 10')} AS ai_score, round(pow(v * o * t, 1.0::DOUBLE / 3) * 10, 6) AS vot FROM (SELECT *, value IS NOT NULL AS quality_known, " + ", ".join(f"coalesce({d}, 5)::DOUBLE AS {d[0]}" for d in DIMS) + " FROM scored)",
    "site_scores": f"SELECT *, CAST(CASE WHEN least_compliance < 6 THEN 50 WHEN mean_relevance < 6 THEN 60 ELSE 100 END AS BIGINT) AS cap FROM (SELECT site, {near('sum(w * ai_score) / sum(w)')} AS ai_score, CASE WHEN bool_or(quality_known) THEN round(coalesce(sum(w * vot) FILTER (counts) / sum(w) FILTER (counts), 0), 6) END AS vot, min(compliance) AS least_compliance, round(avg(relevance), 6) AS mean_relevance FROM (SELECT *, CAST({by_type(U.SCORE_WEIGHTS, 0.5)} AS DOUBLE) AS w, quality_known AND type NOT IN ('required', 'utility') AS counts FROM page_scores) GROUP BY site)",
    "stats": "SELECT site, dimension, floor(avg(v) * 10 + 0.5) / 10 AS mean, min(v) AS least, count(*) FILTER (v < 6) AS n_low, floor(count(*) FILTER (v < 6) * 1000 / count(*) + 0.5) / 10 AS low_percent FROM (" + " UNION ALL ".join(f"SELECT site, '{d}' AS dimension, coalesce({d}, 5) AS v FROM scored" for d in DIMS) + ") GROUP BY site, dimension",
    "comply": "SELECT site, g AS n_grave, d AS n_doubtful, round(mc, 6) AS mean_compliance, CASE WHEN g > 0 THEN 'fail' WHEN d > 0.2 * n THEN 'warn' ELSE 'pass' END AS status FROM (SELECT site, count(*) AS n, count(compliance) AS k, avg(coalesce(compliance, 5)) AS mc, count(*) FILTER (coalesce(compliance, 5) <= 2) AS g, count(*) FILTER (coalesce(compliance, 5) > 2 AND coalesce(compliance, 5) <= 5) AS d FROM scored GROUP BY site) WHERE k > 0",
    "topics": _topics("meta"),
    "details": f"""SELECT site, page_id, title, t AS page_type, lang, total_length AS total_chars, main_length AS content_chars, ratio_percent AS content_ratio, cs AS content_status, concat_ws('; ', CASE WHEN e = 'game' AND t = 'game_detail' THEN 'game can''t be verified' WHEN e = 'video' AND t = 'video_detail' THEN 'video can''t be verified' END,
      CASE WHEN cs = 'warn' THEN 'Thin content (' || main_length || ' chars)' END) AS issues, e AS embed, a AS ai_status, CASE WHEN value IS NOT NULL THEN CASE WHEN relevance >= 7 THEN 'relevant' WHEN relevance >= 4 THEN 'tangential' ELSE 'off-topic' END END AS relevance_label,
      CAST(CASE a WHEN 'fail' THEN 0 WHEN 'warn' THEN 70 ELSE 100 END AS BIGINT) AS score, CASE WHEN cs = 'pass' AND a <> 'pass' THEN a ELSE cs END AS display_status
      FROM (SELECT *, CASE WHEN kind = 'content' AND t NOT IN ('required', 'utility') AND main_length < 300 THEN 'warn' ELSE 'pass' END AS cs, CASE WHEN iframes + canvases > 0 THEN 'game' WHEN videos > 0 THEN 'video' ELSE 'none' END AS e, CASE WHEN value IS NULL THEN NULL WHEN g >= 7 THEN 'pass' WHEN g >= 4 THEN 'warn' ELSE 'fail' END AS a
        FROM (SELECT p.site, p.page_id, {page_type(path_of('p.url'))} AS t, r.total_length, r.main_length, r.ratio_percent, s.iframes, s.canvases, s.videos, m.title, m.lang, k.type AS kind, c.value, c.relevance, pow(c.value::DOUBLE * c.originality * c.relevance * c.compliance * c.translation, 0.2) AS g
          FROM p JOIN ratio r USING (page_id) JOIN signals s USING (page_id) JOIN meta m USING (page_id) JOIN types k ON k.site = p.site JOIN scored c USING (page_id)))""",
    "groups": """SELECT site, page_type, CASE page_type WHEN 'homepage' THEN 1 WHEN 'listing' THEN 2 WHEN 'reference_listing' THEN 3 WHEN 'content' THEN 4 WHEN 'game_detail' THEN 5 WHEN 'video_detail' THEN 6 WHEN 'reference_detail' THEN 7 WHEN 'required' THEN 8 WHEN 'utility' THEN 9 ELSE 10 END::BIGINT AS position,
      count(*) FILTER (bad) AS n_problems, count(*) FILTER (NOT bad) AS n_ok FROM (SELECT *, page_type NOT IN ('required', 'utility') AND (content_status <> 'pass' OR issues <> '' OR coalesce(ai_status <> 'pass', false)) AS bad FROM details) GROUP BY site, page_type""",
    "fresh": _fresh("texts", "site, page_id", "2025-06-30"),
    "subs": "SELECT g.site, count(*) - 1 AS n, sum(iframes) AS frames, count(*) FILTER (g.page_id <> h.page_id AND iframes + canvases > 0) AS embeds, count(*) FILTER (g.page_id <> h.page_id AND iframes + canvases > 0 AND text_length < 100) AS thin_embeds, count(*) FILTER (g.page_id <> h.page_id AND text_length < 100) AS thin, count(*) FILTER (g.page_id <> h.page_id AND text_length < 50) AS thinner FROM signals g JOIN home h USING (site) GROUP BY g.site",
    # phrases repeated many times in a row can't be told in this dialect; only sites of the plain type have this item
    "items": f"""SELECT site, 'site_scale' AS item, 'H' AS bucket, status FROM scale UNION ALL SELECT site, required, 'H', CASE found_by WHEN 'missing' THEN 'warn' ELSE 'pass' END FROM required
      UNION ALL SELECT v.site, 'policy_keywords', 'H', CASE WHEN v.status = 'fail' AND mean_compliance >= 7 THEN 'warn' ELSE v.status END FROM verdict v LEFT JOIN comply USING (site)
      UNION ALL SELECT site, 'ai_compliance', 'H', status FROM comply UNION ALL SELECT site, 'duplication', 'C', status FROM dup
      UNION ALL SELECT site, 'content_ratio', 'C', ratio_status FROM ratio_sites JOIN plain USING (site) UNION ALL SELECT site, 'subpage_depth', 'C', depth_status FROM ratio_sites JOIN plain USING (site) WHERE n_sub > 0
      UNION ALL SELECT site, 'filler', 'C', CASE WHEN sum({count('text', T.FILLER_ZH)} + {count('text', T.FILLER_EN)}) <= 3 * count(*) THEN 'pass' ELSE 'warn' END FROM texts JOIN plain USING (site) GROUP BY site UNION ALL SELECT site, 'template', 'C', 'pass' FROM p GROUP BY site HAVING count(*) >= 3
      UNION ALL SELECT site, 'freshness', 'C', CASE WHEN bool_or(recent) THEN 'pass' ELSE 'warn' END FROM fresh GROUP BY site
      UNION ALL SELECT site, 'game_description', 'C', CASE WHEN thin_embeds / embeds > 0.5 THEN 'warn' ELSE 'pass' END FROM subs JOIN types USING (site) WHERE type = 'game' AND embeds > 0 UNION ALL SELECT site, 'iframe_quality', 'C', CASE WHEN frames > 20 THEN 'warn' ELSE 'pass' END FROM subs JOIN types USING (site) WHERE type = 'game' AND frames > 0
      UNION ALL SELECT site, 'video_description', 'C', CASE WHEN thinner / n > 0.5 THEN 'warn' ELSE 'pass' END FROM subs JOIN types USING (site) WHERE type = 'video' AND n > 0 UNION ALL SELECT site, 'reference_entry', 'C', CASE WHEN thin / n > 0.5 THEN 'warn' ELSE 'pass' END FROM subs JOIN types USING (site) WHERE type = 'reference' AND n > 0
      UNION ALL SELECT r.site, 'home_content', 'L', CASE WHEN main_length >= 500 THEN 'pass' ELSE 'fail' END FROM ratio r JOIN home USING (site, page_id) JOIN plain USING (site) UNION ALL SELECT m.site, 'h1', 'L', CASE WHEN h1_count = 1 THEN 'pass' ELSE 'warn' END FROM meta m JOIN home USING (site, page_id)
      UNION ALL SELECT m.site, 'navigation', 'U', CASE WHEN nav_text <> '' THEN 'pass' ELSE 'warn' END FROM meta m JOIN home USING (site, page_id) UNION ALL SELECT h.site, 'internal_links', 'L', CASE WHEN coalesce(n_same_site, 0) >= 5 THEN 'pass' ELSE 'warn' END FROM home h LEFT JOIN internal USING (site, page_id)
      UNION ALL SELECT s.site, 'viewport', 'L', CASE WHEN has_viewport THEN 'pass' ELSE 'warn' END FROM signals s JOIN home USING (site, page_id) UNION ALL SELECT s.site, 'heading_order', 'U', CASE WHEN heading_skip THEN 'warn' ELSE 'pass' END FROM heads s JOIN home USING (site, page_id)""",
    "tally": f"""SELECT site, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed,
      CASE WHEN bool_or(bucket = 'H' AND status = 'fail') THEN 'fail' WHEN bool_or(bucket = 'H' AND status = 'warn') THEN 'warn' ELSE 'ready' END AS hard_status, round(count(*) FILTER (status = 'warn') / count(*), 6) AS warning_ratio,
      CAST(CASE WHEN count(*) FILTER (status = 'warn') / count(*) > 0.15 THEN floor((count(*) FILTER (status = 'warn') / count(*) - 0.15::DOUBLE) * 100 + 0.5) ELSE 0 END AS BIGINT) AS penalty, {near("count(*) FILTER (status = 'pass') * 100 / count(*)")} AS pass_percent FROM items GROUP BY site""",
    "quality": f"SELECT site, coalesce(avg(s) FILTER (bucket IN ('H', 'C', 'U')), 100) AS sq, coalesce(avg(s) FILTER (bucket = 'L'), 100) AS hq FROM (SELECT *, CASE status WHEN 'pass' THEN 100 WHEN 'warn' THEN 40 ELSE 0 END AS s FROM items) GROUP BY site",
}

ORDER = list(PARTS)


def _sql(final: str, **instead: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{'reach(node, root)' if k == 'reach' else k} AS ({v})" for k, v in (PARTS | instead).items()) + " " + final


def composite(vot: str, site: str, home: str, cap: str) -> str:
    v = f"coalesce({vot}, {near(f'({site} + {home}) / 2')})::DOUBLE"
    return f"CAST(greatest(0, least(100, {near(f'least({v} * {site} / 100 * {home} / 100, {cap})')})) AS BIGINT)"


def _replies(texts: bool = False) -> str:
    def score(d: str) -> str:
        raw = f"json_extract_string(reply, '$.{d}')"
        return f"CASE WHEN NOT list_contains(json_keys(reply), '{d}') THEN 5 WHEN {raw} IS NULL THEN 0 ELSE greatest(0, least(10, floor(coalesce(CASE WHEN trim({raw}) = '' THEN 0 ELSE try_cast({raw} AS DOUBLE) END, 5) + 0.5))) END"

    serves = "coalesce(kind IN ('required', 'utility'), false)"
    own = {"value": "greatest(0, value - penalty)", "originality": "greatest(0, originality - penalty)", "relevance": "relevance", "compliance": "compliance", "translation": "CASE WHEN coalesce(lang IN ('', 'en'), true) THEN 10 ELSE translation END"}
    cols = ", ".join(f"CAST(CASE WHEN body IS NULL THEN NULL {'' if d == 'compliance' else f'WHEN {serves} THEN 10'} ELSE {x} END AS BIGINT) AS {d}" for d, x in own.items())
    mean = "pow(value::DOUBLE * originality * relevance * compliance * translation, 0.2)"
    kinds = ", ".join(f"'{k}'" for k in ("homepage", "listing", "content", "game_detail", "video_detail", "reference_detail", "required", "utility"))
    js = lambda at, name: f"json_extract_string({at}, '$.{name}')"
    if texts:
        last = f"""CASE WHEN body IS NOT NULL THEN coalesce({js('body', 'relevanceLabel')}, CASE WHEN relevance >= 7 THEN 'relevant' WHEN relevance >= 4 THEN 'tangential' ELSE 'off-topic' END) END AS relevance_label, CASE WHEN body IS NULL THEN 'Analysis failed' ELSE coalesce({js('body', 'assessment')}, '') END AS assessment,
          {', '.join(f"CASE WHEN body IS NOT NULL THEN coalesce({js('reply', d + '_reason')}, '') END AS {d}_reason" for d in DIMS)}, coalesce(array_to_string(CAST(json_extract(body, '$.suggestions') AS VARCHAR[]), '; '), '') AS suggestions"""
    else:
        last = f"{', '.join(DIMS)}, CASE WHEN body IS NULL THEN 'warn' WHEN {mean} >= 7 THEN 'pass' WHEN {mean} >= 4 THEN 'warn' ELSE 'fail' END AS status, kind AS page_type"
    return f"""WITH r AS {beside(D.REPLIES, E.REPLIES, 'reply_id, lang, response', 'reply_id')}, b AS (SELECT *, nullif(regexp_extract(response, '(?s)\\{{.*\\}}', 0), '') AS body FROM r),
      n AS (SELECT *, coalesce(CAST(json_extract(body, '$.evaluation_details') AS VARCHAR), body) AS reply, json_extract_string(body, '$.confidence') AS trust, CASE WHEN json_extract_string(body, '$.pageType') IN ({kinds}) THEN json_extract_string(body, '$.pageType') END AS kind FROM b),
      s AS (SELECT *, {', '.join(f'{score(d)} AS {d}' for d in DIMS)}, CASE trust WHEN 'low' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS penalty FROM n), f AS (SELECT reply_id, kind, body, reply, {cols} FROM s)
      SELECT CAST(reply_id AS BIGINT) AS reply_id, {last} FROM f"""


def _freshness() -> str:
    p = q(r"/(20[12][0-9])(?:[-/](1[0-2]|0?[1-9])(?:[^0-9].*|$)|[^0-9].*$|$)")
    d = q(r"/20[12][0-9][-/](?:1[0-2]|0?[1-9])[-/](3[01]|[12][0-9]|0?[1-9])(?:[^0-9]|$)")
    day = f"try_cast(regexp_extract(path, {p}, 1) || '-' || lpad(coalesce(nullif(regexp_extract(path, {p}, 2), ''), '06'), 2, '0') || '-' || lpad(coalesce(nullif(regexp_extract(path, {d}, 1), ''), '15'), 2, '0') AS DATE)"
    rows = f"(SELECT site, page_id + 1000 AS ordinal, {path_of('url')} AS path FROM {CRAWL} UNION ALL SELECT 'fixed.example', ordinal, path FROM {values(E.PATHS, 'ordinal, path')})"
    return f"SELECT site, CAST(ordinal AS BIGINT) AS ordinal, path, CAST(day AS VARCHAR) AS date, row_number() OVER (PARTITION BY site ORDER BY day DESC NULLS LAST, ordinal) AS rank FROM (SELECT *, {day} AS day FROM {rows})"


def _sample(budget: int, most: int) -> str:
    return f"""WITH t AS (SELECT {host_of('url')} AS site, page_id, {page_type(path_of('url'))} AS type FROM pages), w AS (SELECT *, {by_type(U.SAMPLING_WEIGHTS, 3.0)} AS w, type IN ('homepage', 'required') AS always FROM t WHERE type <> 'utility'),
      s AS (SELECT *, sum(CASE WHEN always THEN 0 ELSE w END) OVER (PARTITION BY site) AS total, count(*) OVER (PARTITION BY site, type) AS n, row_number() OVER (PARTITION BY site, type ORDER BY page_id) AS rn FROM w),
      k AS (SELECT * FROM s WHERE always OR rn <= greatest(1, floor(w * n / total * {budget} + 0.5)))
      SELECT site, page_id, type, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY always DESC, w DESC, type, page_id) AS rank FROM k) WHERE rank <= {most}"""


FILES_SQL = f"(SELECT sitemap, '<' || kind || '>' || string_agg(line, '' ORDER BY spot, line) || '</' || kind || '>' AS xml FROM ({made(D.SITEMAP_LINES)}) AS made_ GROUP BY sitemap, kind UNION ALL SELECT sitemap, xml FROM {values(E.SITEMAPS, 'k, sitemap, xml')})"
ROBOTS_SQL = f"SELECT DISTINCT site, regexp_extract(trim(replace(line, chr(13), '')), '(?i)^sitemap:\\s*(\\S+)', 1) AS sitemap FROM (SELECT site, unnest(string_split(robots_txt, chr(10))) AS line FROM (SELECT site, robots_txt FROM ({made(D.RESOURCES)}) AS made_ WHERE robots_ok UNION ALL SELECT site, robots_txt FROM {values(E.ROBOTS, 'k, site, robots_txt')})) WHERE regexp_matches(trim(line), '(?i)^sitemap:\\s*\\S')"


def _walked(roots: str) -> str:
    """site, url of the pages that sitemaps name from roots (site, sitemap) on, three indexes deep."""
    return f"""WITH RECURSIVE files AS (SELECT regexp_replace(sitemap, '/+$', '') AS sitemap, xml, regexp_matches(xml, '(?i)<sitemap[\\s>]') AS idx FROM {FILES_SQL}), roots AS ({roots}),
  locs AS (SELECT sitemap, idx, unnest(regexp_extract_all(xml, '(?s)<loc>\\s*(.*?)\\s*</loc>', 1)) AS url FROM files), walk(site, sitemap, depth) AS (SELECT site, regexp_replace(sitemap, '/+$', ''), 0 FROM roots
  UNION SELECT w.site, regexp_replace(l.url, '/+$', ''), w.depth + 1 FROM walk w JOIN locs l ON l.sitemap = w.sitemap AND l.idx AND regexp_matches(l.url, '^https?://') WHERE w.depth < 3)
  SELECT DISTINCT w.site, l.url FROM walk w JOIN locs l ON l.sitemap = w.sitemap AND NOT l.idx AND regexp_matches(l.url, '^https?://')"""


SITEMAP_SQL = _walked(ROBOTS_SQL)
DEFAULT_SQL = _walked(f"SELECT site, 'https://' || site || '/sitemap.xml' AS sitemap FROM ({made(D.RESOURCES)}) AS made_ WHERE sitemap_ok UNION ALL SELECT 'a.example', 'https://a.example/t.xml'")


REPORT_SQL = f"""SELECT q.site, {near('sq')} AS site_quality, {near('hq')} AS home_quality, {near('x')} AS vot, coalesce(cap, 100) AS cap, {composite('v', 'sq', 'hq', 'coalesce(cap, 100)')} AS composite,
          {near("x * 0.6::DOUBLE + (sq + hq) / 2 * 0.4::DOUBLE")} AS soft_score, hard_status, passed, warned, failed, warning_ratio, n_pages, type
          FROM (SELECT *, coalesce(v, {near('(sq + hq) / 2')}::DOUBLE) AS x FROM quality LEFT JOIN (SELECT site, vot AS v, cap FROM site_scores) USING (site)) q JOIN tally USING (site) JOIN types USING (site)"""


def _cases() -> str:
    return f"SELECT 'cases.example' AS site, k + {E.CASES} AS page_id, 'https://cases.example' || path AS url, html FROM {values(E.PAGES, 'k, path, html')} UNION ALL SELECT * FROM {CRAWL}"


PROMPTS_SQL = f"""SELECT x.site, x.page_id, {q("""You judge pages for an advertising programme. Answer with one JSON object and nothing else.
pageType: one of homepage, listing, content, game_detail, video_detail, reference_detail, required, utility.
evaluation_details: an object with value, originality, relevance, compliance and translation, each from 0 to 10, and with the reason of each in value_reason, originality_reason, relevance_reason, compliance_reason and translation_reason.
relevanceLabel: relevant, tangential or off-topic. confidence: high, medium or low. assessment: a short text. suggestions: one to three texts.
Date: 2025-06-30
Language of the reply: English
""")} || coalesce('Topic: ' || t.topic || chr(10), '') || coalesce('Type: ' || t.type || chr(10), '') || coalesce('About: ' || t.description || chr(10), '') || 'Declared language: ' || CASE WHEN m.lang = '' THEN 'English' ELSE m.lang END || chr(10)
  || 'Embed: ' || CASE WHEN iframes > 0 OR canvases > 0 THEN 'game' WHEN videos > 0 THEN 'video' ELSE 'none' END || chr(10) || 'Listing: ' || list_items || ' items, pagination ' || has_pagination || ', categories ' || has_categories || ', search ' || has_search || chr(10)
  || 'Page: ' || x.url || chr(10) || chr(10) || left(x.text, 5000) AS prompt FROM texts x JOIN signals g USING (page_id) JOIN meta m USING (page_id) LEFT JOIN topics t ON t.site = x.site"""
REHEARSED = """'{"value": ' || n % 10 || ', "originality": ' || n % 7 || ', "relevance": ' || n % 9 || ', "compliance": 9, "translation": 8, "confidence": "high"}'"""


def _attribute(name: str) -> str:
    pattern = q(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    return "concat(" + ", ".join(f"regexp_extract(t, {pattern}, {k})" for k in (1, 2, 3)) + ")"


def _styles() -> str:
    """Rules of style elements and elements met by key; written from the same rules as the operator."""
    value = lambda p: f"trim(list_extract(regexp_extract_all(lower(body), {q(r'(?:^|[;{\s])' + p + r'\s*:\s*([^;!}]+)')}, 1), -1))"
    px = lambda x: f"CASE WHEN regexp_matches({x}, '^([0-9]*\\.?[0-9]+)(?:px|pt|r?em)?$') THEN try_cast(regexp_extract({x}, '^([0-9]*\\.?[0-9]+)', 1) AS DOUBLE) * CASE WHEN {x} LIKE '%pt' THEN 4 / 3 WHEN {x} LIKE '%em' THEN 16 ELSE 1 END END"
    names = ("font-size", "display", "visibility", "opacity", "width", "height")
    won = ", ".join(f"(SELECT {value(p)} FROM met m WHERE m.page_id = e.page_id AND m.at_ = e.at_ AND {value(p)} IS NOT NULL ORDER BY rank DESC LIMIT 1) AS v{k}" for k, p in enumerate(names))
    simple = q(r"^([a-zA-Z][a-zA-Z0-9]*)?(?:([.#])([A-Za-z_-][A-Za-z0-9_-]*))?$")
    return rf"""WITH p AS ({_cases()}), bare AS (SELECT site, page_id, {replaced(replaced('html', '(?s)<!--.*?-->', ''), '(?is)<script[^>]*>.*?</script>', '')} AS html FROM p),
      css AS (SELECT page_id, {replaced("array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10))", r'(?s)/\*.*?\*/', '')} AS css FROM bare),
      blocks AS (SELECT page_id, unnest(regexp_extract_all(css, '([^{{}};]+)\{{([^{{}}]*)\}}', 1)) AS s, unnest(regexp_extract_all(css, '([^{{}};]+)\{{([^{{}}]*)\}}', 2)) AS body, unnest(range(len(regexp_extract_all(css, '([^{{}};]+)\{{([^{{}}]*)\}}', 1)))) AS k FROM css),
      ones AS (SELECT page_id, k, body, trim(regexp_replace(u, '\s+', ' ', 'g')) AS s FROM (SELECT page_id, k, body, unnest(string_split(s, ',')) AS u FROM blocks)),
      rules AS (SELECT page_id, body, lower(regexp_extract(s, {simple}, 1)) AS tag, regexp_extract(s, {simple}, 2) AS kind, regexp_extract(s, {simple}, 3) AS name, k FROM ones WHERE s <> '' AND regexp_matches(s, {simple})),
      tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<[a-z][a-z0-9]*(?:\s[^>]*)?>')) AS t, unnest(range(len(regexp_extract_all(html, '(?is)<[a-z][a-z0-9]*(?:\s[^>]*)?>')))) AS at_ FROM bare),
      el AS (SELECT page_id, at_, lower(regexp_extract(t, '^<([A-Za-z0-9]+)', 1)) AS tag, {_attribute('class')} AS c, {_attribute('id')} AS id, {_attribute('style')} AS own, {_attribute('width')} AS w, {_attribute('height')} AS h FROM tags),
      met AS (SELECT e.page_id, e.at_, r.body, CASE r.kind WHEN '#' THEN 100 WHEN '.' THEN 10 ELSE 0 END * 1000000 + CASE WHEN r.tag <> '' THEN 1000000 ELSE 0 END + r.k AS rank FROM el e JOIN rules r ON r.page_id = e.page_id AND (r.tag = '' OR r.tag = e.tag)
        AND CASE r.kind WHEN '#' THEN r.name = e.id WHEN '.' THEN list_contains(regexp_split_to_array(e.c, '\s+'), r.name) ELSE true END UNION ALL SELECT page_id, at_, own, 1000000000000000 FROM el WHERE own <> ''),
      seen AS (SELECT e.*, {won} FROM el e), flags AS (SELECT *, coalesce(v1 = 'none', false) OR coalesce(v2 = 'hidden', false) AS hidden, {px('v0')} AS font, coalesce({px('v4')}, {px('w')}) AS wide, coalesce({px('v5')}, {px('h')}) AS high FROM seen)
      SELECT b.site, b.page_id, count(*) FILTER (tag IN ('p', 'span', 'a', 'li') AND font > 0 AND font < 12) AS small_letters, count(*) FILTER ((regexp_matches(c, 'modal|popup|overlay') OR regexp_matches(id, 'modal|popup')) AND NOT hidden AND coalesce(try_cast(v3 AS DOUBLE) <> 0, true)) AS popups,
        count(*) FILTER (tag = 'iframe' AND (hidden OR coalesce(wide <= 50, false) OR coalesce(high <= 50, false))) AS unseen_frames FROM bare b LEFT JOIN flags f ON f.page_id = b.page_id GROUP BY b.site, b.page_id"""


def _lines() -> str:
    """Lines of whole reports in both languages, the texts written out."""
    r, out = f"({REPORT_SQL}) r", []
    bucket = "CASE bucket WHEN 'H' THEN 10 WHEN 'C' THEN 12 WHEN 'L' THEN 14 ELSE 16 END"
    bad = "(SELECT * FROM details WHERE content_status <> 'pass' OR issues <> '' OR ai_status <> 'pass')"
    for lang, t in {
        "en": ("'# Audit of ' || site", "'Score ' || composite || ' of 100, soft score ' || soft_score || '; requirements: ' || hard_status || '.'", "passed || ' checks passed, ' || warned || ' to improve, ' || failed || ' failed.'", ("Requirements", "Content", "Landing page", "Use"), (": ", "passed", "to improve", "failed"), "Pages", "': ' || n_problems || ' with problems, ' || n_ok || ' without'", "Pages with problems"),
        "zh": ("'# ' || site || ' 的检查'", "'得分 ' || composite || '/100，软分 ' || soft_score || '；要求：' || hard_status || '。'", "'通过 ' || passed || ' 项，待改进 ' || warned || ' 项，未通过 ' || failed || ' 项。'", ("要求", "内容", "首页", "使用"), ("：", "通过", "待改进", "未通过"), "页面", "'：有问题 ' || n_problems || '，无问题 ' || n_ok", "有问题的页面"),
    }.items():
        heads = " ".join(f"WHEN '{b}' THEN '## {n}'" for b, n in zip("HCLU", t[3], strict=True))
        said = " ".join(f"WHEN '{x}' THEN '{n}'" for x, n in zip(("pass", "warn", "fail"), t[4][1:], strict=True))
        rows = [f"SELECT site, 0 AS part, '' AS ordinal, {t[0]} AS line FROM {r}", f"SELECT site, 1, '', {t[1]} FROM {r}", f"SELECT site, 2, '', {t[2]} FROM {r}", f"SELECT DISTINCT site, {bucket}, '', CASE bucket {heads} END FROM items",
          f"SELECT site, {bucket} + 1, item, '- ' || item || '{t[4][0]}' || CASE status {said} END FROM items", f"SELECT site, 20, '', '## {t[5]}' FROM {r}", f"SELECT site, 21, lpad(CAST(position AS VARCHAR), 4, '0'), '- ' || page_type || {t[6]} FROM groups",
          f"SELECT DISTINCT site, 30, '', '## {t[7]}' FROM {bad}", f"SELECT site, 31, lpad(CAST(page_id AS VARCHAR), 20, '0'), '- ' || page_id || ': ' || display_status || ' ' || issues FROM {bad}"]
        out += [f"SELECT *, '{lang}' AS lang FROM ({x})" for x in rows]
    return " UNION ALL ".join(out)


CHAINED = f"SELECT site, page_id, url, html FROM ({made(D.CHAINED)}) AS made_"


def oracle_sql() -> dict[str, str]:
    return {
        "url_normalize_dedup": f"SELECT {host_of('url')} AS site, page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS norm_url FROM pages QUALIFY row_number() OVER (PARTITION BY {host_of('url')}, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') ORDER BY page_id) = 1",
        "url_classify": f"SELECT url, {page_type(path_of('url'))} AS type FROM (SELECT url FROM pages UNION SELECT 'https://fixed.example' || p FROM {values(E.URLS, 'k, p')})",
        "content_url_filter": _sql("SELECT site, href FROM content_links"),
        "url_freshness": _freshness(),
        "stratified_sample": _sample(5, 8),
        "page_text": _sql("SELECT site, page_id, text FROM texts"),
        "page_meta": _sql("SELECT * FROM meta"),
        "page_links_internal": _sql("SELECT * FROM internal"),
        "page_signals": _sql("SELECT * EXCLUDE (f) FROM signals"),
        "signal_cases": _sql("SELECT * EXCLUDE (f), array_to_string(f, ' ') AS sources FROM signals", p=_cases()),
        "meta_cases": _sql("SELECT site, page_id, title, description, og_description, lang, h1_text FROM meta", p=_cases()),
        "link_cases": _sql("SELECT site, page_id, pos, href, anchor_text FROM links", p=_cases()),
        "page_styles": _styles(),
        "heading_skip": _sql("SELECT * FROM heads"),
        "required_pages": _sql("SELECT * FROM required"),
        "main_content": _sql("SELECT site, page_id, main_text FROM main"),
        "content_ratio_depth": _sql("SELECT * FROM ratio_sites"),
        "content_ratio_pages": _sql("SELECT * FROM ratio"),
        "filler_scan": f"SELECT doc_id, {count('text', T.FILLER_ZH)} AS n_zh, {count('text', T.FILLER_EN)} AS n_en FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "ngram_jaccard_pairs": _sql("SELECT * FROM jaccard"),
        "duplication_score": _sql("SELECT * FROM dup"),
        "template_pairs": _sql("SELECT * FROM templates"),
        "template_clusters": _sql("SELECT * FROM clusters"),
        "freshness_dates": _dates(),
        "policy_keywords": _sql("SELECT * FROM hits"),
        "policy_verdict": _sql("SELECT * FROM verdict"),
        "site_type_detect": _sql("SELECT * FROM types"),
        "site_scale": _sql("SELECT * FROM scale"),
        "ai_parse_scores": _replies(),
        "page_ai_score": _sql("SELECT site, page_id, ai_score FROM page_scores"),
        "page_vot": _sql("SELECT site, page_id, vot FROM page_scores WHERE quality_known"),
        "site_ai_score": _sql("SELECT site, ai_score FROM site_scores"),
        "site_vot": _sql("SELECT site, vot FROM site_scores"),
        "ai_dimension_stats": _sql("SELECT * FROM stats"),
        "ai_compliance": _sql("SELECT * FROM comply"),
        "score_caps": _sql("SELECT site, least_compliance, mean_relevance, cap FROM site_scores"),
        "check_items": _sql("SELECT * FROM items"),
        "category_scores": _sql("SELECT site, bucket, CAST(sum(CASE status WHEN 'pass' THEN 100 WHEN 'warn' THEN 40 ELSE 0 END) AS BIGINT) AS score, count(*) * 100 AS max_score FROM items GROUP BY site, bucket"),
        "hard_status": _sql("SELECT site, hard_status, passed, warned, failed, pass_percent FROM tally"),
        "warning_ratio": _sql("SELECT site, warning_ratio, penalty FROM tally"),
        "composite_score": f"SELECT CAST(case_id AS BIGINT) AS case_id, {composite('vot', 'sq', 'hq', 'CASE WHEN c < 6 THEN 50 WHEN r < 6 THEN 60 ELSE 100 END')} AS composite FROM (SELECT * FROM ({made(D.COMPOSITES)}) AS made_(case_id, vot, sq, hq, c, r) UNION ALL SELECT * FROM {values(E.COMPOSITES, 'case_id, vot, sq, hq, c, r')})",
        "approval_estimate": f"SELECT CAST(case_id AS BIGINT) AS case_id, {_factors('c')} FROM (SELECT case_id, c, h, a, o, n, low / 100 AS l FROM (SELECT * FROM ({made(D.APPROVALS)}) AS made_(case_id, c, h, a, o, low, n) UNION ALL SELECT * FROM {values(E.APPROVALS, 'case_id, c, h, a, o, low, n')}))",
        "robots_sitemaps": ROBOTS_SQL,
        "sitemap_expand": SITEMAP_SQL,
        "suggestion_dedup": f"""SELECT site, row_number() OVER (PARTITION BY site ORDER BY late, ordinal, suggestion) AS position, suggestion FROM (SELECT site, 0 AS late, ordinal, suggestion FROM ({made(D.ACTIONS)}) AS made_
          UNION ALL (SELECT site, 1, ordinal, suggestion FROM (SELECT * FROM ({made(D.SUGGESTIONS)}) AS made_ UNION ALL SELECT 'fixed.example', ordinal, suggestion FROM {values(E.SUGGESTIONS, 'ordinal, suggestion')}) QUALIFY row_number() OVER (PARTITION BY site, left(suggestion, 40) ORDER BY ordinal, suggestion) = 1))""",
        "site_quality_report": _sql(REPORT_SQL),
        "saved_report_scores": _sql(REPORT_SQL),
        "ai_reply_texts": _replies(True),
        "site_topics": _sql("SELECT * FROM topics"),
        "topic_cases": _sql("SELECT * FROM topics", meta=PARTS["meta"].replace("SELECT site, page_id,", "SELECT page_id, site,", 1) + f" UNION ALL SELECT page_id, site, title, description, og_description, 'en', nav_text, '', h1_text, 0 FROM {values(E.METAS, 'page_id, site, title, description, og_description, h1_text, nav_text')}"),
        "topic_replies": f"""SELECT site, CASE WHEN json_extract_string(b, '$.type') IN ('content', 'tool', 'game', 'video', 'reference') THEN json_extract_string(b, '$.type') ELSE 'unsupported' END AS type, coalesce(json_extract_string(b, '$.topic'), 'Unknown') AS topic, CASE WHEN b IS NULL THEN 'Topic analysis failed' ELSE coalesce(json_extract_string(b, '$.description'), '') END AS description,
          coalesce(json_extract_string(b, '$.confidence'), 'low') AS confidence, CASE WHEN b IS NOT NULL THEN coalesce(json_extract_string(b, '$.isYMYL') = 'true', false) END AS is_ymyl, CASE WHEN json_type(b, '$.nicheFocusScore') <> 'VARCHAR' THEN CAST(greatest(1, least(10, CAST(json_extract_string(b, '$.nicheFocusScore') AS DOUBLE))) AS DOUBLE) END AS focus
          FROM (SELECT site, nullif(regexp_extract(response, '(?s)\\{{.*\\}}', 0), '') AS b FROM {beside(D.TOPICS, E.TOPICS, 'site, response')})""",
        "site_type_resolved": _sql("SELECT t.site, coalesce(o.type, t.type) AS type, CASE WHEN o.type IS NULL THEN t.confidence ELSE o.confidence END AS confidence FROM types t LEFT JOIN topics o USING (site)"),
        "page_prompts": _sql(f"SELECT * FROM ({PROMPTS_SQL})"),
        "page_replies": _sql(f"""SELECT site, page_id, CASE WHEN n % 11 <> 0 THEN {REHEARSED} END AS response, CASE WHEN n % 11 = 0 THEN 'ValueError: no answer' END AS error, CAST(CASE WHEN n % 11 = 0 THEN 3 WHEN n % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts
          FROM (SELECT site, page_id, length(prompt) AS n FROM ({PROMPTS_SQL}))"""),
        "page_reply_scores": _sql(f"""SELECT reply_id, CASE WHEN n % 11 <> 0 THEN n % 10 END AS value, CASE WHEN n % 11 <> 0 THEN n % 7 END AS originality, CASE WHEN n % 11 <> 0 THEN n % 9 END AS relevance, CASE WHEN n % 11 <> 0 THEN CAST(9 AS BIGINT) END AS compliance, CASE WHEN n % 11 <> 0 THEN CAST(CASE WHEN lang IN ('', 'en') THEN 10 ELSE 8 END AS BIGINT) END AS translation,
          CASE WHEN n % 11 = 0 THEN 'warn' WHEN mean >= 7 THEN 'pass' WHEN mean >= 4 THEN 'warn' ELSE 'fail' END AS status FROM (SELECT page_id AS reply_id, lang, n, pow((n % 10)::DOUBLE * (n % 7) * (n % 9) * 9 * CASE WHEN lang IN ('', 'en') THEN 10 ELSE 8 END, 0.2) AS mean FROM (SELECT page_id, length(prompt) AS n FROM ({PROMPTS_SQL})) JOIN meta USING (page_id))"""),
        "summary_replies": f"""SELECT CAST(k AS BIGINT) AS reply_id, CASE WHEN p IS NOT NULL THEN CAST(greatest(0, least(100, p)) AS DOUBLE) END AS probability, {', '.join(f"coalesce(json_extract_string(b, '$.{f}'), '') AS {a}" for f, a in (('verdict', 'verdict'), ('analysis', 'analysis'), ('detailedSummary', 'summary')))},
          {', '.join(f"coalesce(array_to_string(CAST(json_extract(b, '$.{f}') AS VARCHAR[]), '; '), '') AS {a}" for f, a in (('reasons', 'reasons'), ('topActions', 'actions')))} FROM (SELECT *, try_cast(json_extract_string(b, '$.probability') AS DOUBLE) AS p FROM (SELECT k, nullif(regexp_extract(response, '(?s)\\{{.*\\}}', 0), '') AS b FROM (SELECT reply_id AS k, response FROM {beside(D.SUMMARIES, E.SUMMARIES, 'reply_id, response', 'reply_id')})) WHERE b IS NOT NULL)""",
        "page_details": _sql("SELECT * FROM details"),
        "page_records": _sql(f"SELECT d.*, {', '.join(f'a.{x}' for x in DIMS)}, {', '.join(f'b.{x}_reason' for x in DIMS)}, b.assessment, coalesce(b.suggestions, '') AS suggestions FROM details d LEFT JOIN ({_replies()}) a ON a.reply_id = d.page_id + 1000 LEFT JOIN ({_replies(True)}) b ON b.reply_id = d.page_id + 1000"),
        "content_findings": _sql(f"""SELECT site, 'low_ratio' AS finding, page_id, ratio_percent || '% (' || main_length || ' chars)' AS detail FROM ratio WHERE main_length / greatest(total_length, 1) < 0.3 AND total_length > 200
          UNION ALL SELECT r.site, 'thin', r.page_id, main_length || ' chars' FROM ratio r JOIN home h ON h.site = r.site AND h.page_id <> r.page_id WHERE main_length < 300
          UNION ALL SELECT x.site, 'stale', x.page_id, '' FROM texts x JOIN ({_fresh('texts', 'page_id', E.AS_OF)}) f USING (page_id) WHERE NOT recent AND length(text) > 200"""),
        "report_phases": _sql("SELECT 'facts' AS phase, CAST(1 AS BIGINT) AS position, count(*) AS n_rows FROM p UNION ALL SELECT 'main', 2, count(*) FROM p UNION ALL SELECT 'items', 3, count(*) FROM items"),
        "report_lines": _sql(_lines()),
        "problem_pages": _sql("SELECT site, page_id, display_status, issues FROM details WHERE content_status <> 'pass' OR issues <> '' OR ai_status <> 'pass'"),
        "pages_by_type": _sql("SELECT * FROM groups"),
        "report_markdown": _sql(f"""SELECT r.site, '# ' || r.site || chr(10) || chr(10) || 'Score: ' || composite || '/100. Requirements: ' || hard_status || '. Checks: ' || passed || ' passed, ' || warned || ' warned, ' || failed || ' failed.' || chr(10) || chr(10) || g.lines AS markdown
          FROM ({REPORT_SQL}) r JOIN (SELECT site, string_agg('- ' || page_type || ': ' || n_problems || ' with problems, ' || n_ok || ' without', chr(10) ORDER BY position) AS lines FROM groups GROUP BY site) g USING (site)"""),
        "site_approval": _sql(f"""SELECT site, {_factors('composite')} FROM (SELECT r.site, composite, hard_status AS h, n, CASE WHEN known THEN ai_score ELSE 0 END AS a, CASE WHEN known THEN least_o END AS o, CASE WHEN known THEN low / n END AS l FROM ({REPORT_SQL}) r JOIN (SELECT site, count(*) AS n, bool_or(ai_status IS NOT NULL) AS known FROM details GROUP BY site) USING (site)
          JOIN (SELECT site, max(n_low) AS low, min(least) FILTER (dimension = 'originality') AS least_o FROM stats GROUP BY site) USING (site) JOIN (SELECT site, ai_score FROM site_scores) USING (site))"""),
        "crawl_candidates": _sql("""SELECT site, norm_url, row_number() OVER (PARTITION BY site ORDER BY page_id, pos, norm_url) AS rank FROM (SELECT l.site, regexp_replace(regexp_replace(l.href, '#.*$', ''), '/+$', '') AS norm_url, page_id, pos FROM links l JOIN content_links USING (site, href)
          QUALIFY row_number() OVER (PARTITION BY l.site, norm_url ORDER BY page_id, pos) = 1) c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.site = c.site AND regexp_replace(regexp_replace(p.url, '#.*$', ''), '/+$', '') = c.norm_url) QUALIFY rank <= 50"""),
        "resource_items": f"""WITH r AS (SELECT * FROM {beside(D.RESOURCES, E.RESOURCES, 'site, robots_ok, robots_txt, sitemap_ok, ads_ok')} UNION ALL SELECT 'e.example', NULL, NULL, NULL, NULL), f AS (SELECT site, coalesce(robots_ok, false) AS robots, coalesce(sitemap_ok, false) OR coalesce(robots_ok AND regexp_matches(robots_txt, '(?im)^[ \\t\\r]*sitemap:\\s*\\S'), false) AS sitemap, coalesce(ads_ok, false) AS ads FROM r)
          {' UNION ALL '.join(f"SELECT site, '{n}' AS item, 'L' AS bucket, CASE WHEN {n} THEN 'pass' ELSE 'warn' END AS status FROM f" for n in ('robots', 'sitemap', 'ads'))}""",
        "sitemap_sources": f"WITH d AS ({DEFAULT_SQL}) SELECT site, url FROM ({SITEMAP_SQL}) WHERE site NOT IN (SELECT site FROM d) UNION SELECT site, url FROM d",
        "flat_sitemap": f"SELECT DISTINCT sitemap AS site, unnest(regexp_extract_all(xml, '<loc>([^<]+)', 1)) AS url FROM {FILES_SQL}",
        "dead_links": _sql(f"SELECT site, url, coalesce(CAST(status AS VARCHAR), 'timeout') AS reason FROM {beside(D.RESPONSES, E.RESPONSES, 'site, url, status')} WHERE status IS NULL OR status >= 400"),
        "link_items": _sql(f"""SELECT site, dead AS n_dead, round(ratio, 6) AS dead_ratio, CASE WHEN ratio < 0.2 AND same >= 5 THEN 'pass' ELSE 'warn' END AS status FROM (SELECT *, CASE WHEN n > 0 THEN dead / n ELSE 0.0::DOUBLE END AS ratio FROM (SELECT l.site, any_value(n) AS n, any_value(same) AS same, count(url) AS dead
          FROM (SELECT site, n_links AS n, n_same_site AS same FROM internal JOIN home USING (site, page_id) UNION ALL SELECT site, n, same FROM {values(E.HOME_LINKS, 'k, site, n, same')}) l
          LEFT JOIN (SELECT * FROM {beside(D.RESPONSES, E.RESPONSES, 'site, url, status')} WHERE status IS NULL OR status >= 400) r USING (site) GROUP BY l.site))"""),
        "site_url_order": _sql("""SELECT site, norm_url, url, CASE k WHEN 0 THEN 'link' ELSE 'sitemap' END AS source, row_number() OVER (PARTITION BY site ORDER BY k, spot, norm_url) AS ordinal
          FROM (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS norm_url FROM (SELECT l.site, href AS url, 0 AS k, pos AS spot FROM links l JOIN home USING (site, page_id) UNION ALL SELECT site, url, 1, page_id FROM p) WHERE %s = site AND %s
          QUALIFY row_number() OVER (PARTITION BY site, norm_url ORDER BY k, spot, url) = 1)""" % (host_of("url"), is_content("url"))),
        "crawl_depth": _sql("SELECT * FROM depths", p=CHAINED),
        "crawl_reach": _sql("SELECT site, count(*) AS n_pages, count(depth) AS n_reached, count(*) - count(depth) AS n_unreachable, max(depth) AS deepest, round(avg(depth), 6) AS mean_depth FROM depths GROUP BY site", p=CHAINED),
    }
