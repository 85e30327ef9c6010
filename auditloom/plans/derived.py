"""Inputs that no given table holds, derived from the crawl: replies, resources, responses, numbers to score.

Each is one SELECT over {pages} (site, page_id, url, html) or {links} (site, href), in the SQL that
Spark and DuckDB share, so both engines start from the same rows and apply their rules to them apart.
Their rows grow with the crawl; the fixed rows of examples.py, which reach rare branches, stand beside them.
"""

from __future__ import annotations

_DIMS = """"value": ' || (page_id % 12 - 1) || ', "originality": ' || (page_id % 10) || ', "relevance": "' || (page_id * 3 % 11) || '", "compliance": ' || CASE WHEN page_id % 17 = 0 THEN 'null' ELSE CAST(page_id % 13 AS VARCHAR(20)) END || ', "translation": ' || (page_id % 11) || '.5, "value_reason": "reason ' || page_id || '" ' || '"""
_HEAD = """"confidence": "' || CASE page_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END || '", "pageType": "' || CASE page_id % 5 WHEN 0 THEN 'content' WHEN 1 THEN 'required' WHEN 2 THEN 'utility' WHEN 3 THEN 'listing' ELSE 'odd' END || '", "suggestions": ["add ' || page_id % 11 || '", "cut"], """

#: A reply of the page model to each page; one in seven has no object.
REPLIES = f"""SELECT page_id + 1000 AS reply_id, CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '' END AS lang,
  CASE WHEN page_id % 7 = 0 THEN 'nothing of use' WHEN page_id % 5 = 0 THEN 'Well: {{{{{_HEAD}"evaluation_details": {{{{{_DIMS}}}}}, "assessment": "page ' || page_id || '"}}}} so' ELSE '{{{{{_HEAD}{_DIMS}}}}}' END AS response FROM {{pages}}"""
#: A reply of the topic model to each site.
TOPICS = """SELECT site, CASE WHEN h % 9 = 0 THEN 'no idea' ELSE '{{"type": "' || CASE h % 6 WHEN 0 THEN 'content' WHEN 1 THEN 'tool' WHEN 2 THEN 'game' WHEN 3 THEN 'video' WHEN 4 THEN 'reference' ELSE 'shop' END || '", "topic": "' || site || '", "confidence": "high", "isYMYL": ' || CASE WHEN h % 2 = 0 THEN 'true' ELSE 'false' END || ', "nicheFocusScore": ' || (h % 14) || '}}' END AS response
  FROM (SELECT site, min(page_id) AS h FROM {pages} GROUP BY site) AS t"""
#: A reply of the summary model to each site.
SUMMARIES = """SELECT h + 1000 AS reply_id, CASE WHEN h % 8 = 0 THEN 'none' ELSE 'So {{"probability": ' || (h % 140 - 10) || ', "verdict": "v' || h || '", "reasons": ["r' || h % 5 || '", "s"], "topActions": ["a' || h % 3 || '"], "detailedSummary": "' || site || '"}}' END AS response
  FROM (SELECT site, min(page_id) AS h FROM {pages} GROUP BY site) AS t"""
#: What each site serves beside its pages.
RESOURCES = """SELECT site, h % 5 <> 0 AS robots_ok, CASE h % 3 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Sitemap: https://' || site || '/sitemap.xml' WHEN 1 THEN 'sitemap:https://' || site || '/sitemap.xml/' ELSE 'Disallow: /x' END AS robots_txt, CASE WHEN h % 4 = 0 THEN true WHEN h % 4 = 1 THEN false END AS sitemap_ok, CASE WHEN h % 6 < 3 THEN h % 2 = 0 END AS ads_ok
  FROM (SELECT site, min(page_id) AS h FROM {pages} GROUP BY site) AS t"""
#: URLs that one sitemap file lists at most.
FILE = 50
#: A line of a sitemap for each page: file k of its site, which the site's index names.
SITEMAP_LINES = f"""SELECT 'https://' || site || '/map' || CAST(floor(page_id / {FILE}) AS BIGINT) || '.xml' AS sitemap, page_id AS spot, '<url><loc>' || url || '</loc></url>' AS line, 'urlset' AS kind FROM {{pages}}
  UNION ALL SELECT DISTINCT 'https://' || site || '/sitemap.xml', CAST(floor(page_id / {FILE}) AS BIGINT), '<sitemap><loc>https://' || site || '/map' || CAST(floor(page_id / {FILE}) AS BIGINT) || '.xml</loc></sitemap>', 'sitemapindex' FROM {{pages}}"""
#: What a check of each linked address got.
RESPONSES = """SELECT DISTINCT site, href AS url, CASE length(href) % 9 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 399 WHEN 3 THEN 200 WHEN 4 THEN NULL ELSE 200 END AS status FROM {links}"""
#: Numbers to score, one row a page.
COMPOSITES = """SELECT page_id + 1000 AS case_id, CASE WHEN page_id % 9 <> 0 THEN page_id * 7 % 101 END AS vot, page_id * 13 % 101 AS site_quality, page_id * 17 % 101 AS home_quality, page_id % 11 AS least_compliance, page_id * 3 % 11 AS mean_relevance FROM {pages}"""
APPROVALS = """SELECT page_id + 1000 AS case_id, page_id * 7 % 101 AS composite, CASE page_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'fail' ELSE 'warn' END AS hard_status, page_id * 5 % 101 AS ai_score, page_id % 11 AS least_originality, page_id * 3 % 101 AS low_percent, page_id % 15 AS n_pages FROM {pages}"""
#: A suggestion for each page, and actions for each site as a whole.
SUGGESTIONS = """SELECT site, page_id AS ordinal, CASE page_id % 4 WHEN 0 THEN 'Say who writes here and why readers should trust it, page ' || page_id WHEN 1 THEN 'Add figures of your own' WHEN 2 THEN 'Add figures of your own ' ELSE 'Page ' || page_id || ' repeats what others of the site say; make it stand on its own' END AS suggestion FROM {pages}"""
ACTIONS = """SELECT site, k AS ordinal, 'Add figures of your own, first of all on page ' || (h + k) AS suggestion FROM (SELECT site, min(page_id) AS h FROM {pages} GROUP BY site) AS t, (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS n WHERE h % 3 <> 0"""
#: The crawl's pages with links to two later ones each, page k of a site to pages 2k and 2k + 1, so that there is something to follow; nothing leads to one page in seven.
CHAINED = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM {pages}),
  n AS (SELECT site, CAST(floor(k / 2) AS BIGINT) AS k, min(url) AS first, max(url) AS last FROM t WHERE page_id % 7 <> 0 GROUP BY site, CAST(floor(k / 2) AS BIGINT))
  SELECT t.site, t.page_id, t.url, CASE WHEN n.k IS NULL THEN t.html ELSE t.html || '<a class="n" href="' || n.first || '">first</a><a href=' || n.last || '#x>last</a>' END AS html FROM t LEFT JOIN n ON n.site = t.site AND n.k = t.k"""
