"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element. Text inside menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments is left
out. The lengths of the lines that remain are summed over a sliding window; where a sum
reaches a threshold the text surges, after the last such window it dives. That is done for
each article or main element by itself and for the lines outside of them. The part with
the most text between its surge and its dive decides: if it is an article or main element,
all such elements in which text surges are the text, whole; else the lines outside of them
from the first surge to the last dive. Where nothing surges, all that remains is the text.

Results in special cases: null, empty and text-free html give an empty text; of parts with
equally much text the first decides; markup cut off at the end is dropped; repeated rows
each give a row; a very long page is worked through once, line by line; an empty table gives
an empty one; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Lines in the sliding window, and the code points in it at which text surges.
WINDOW, SURGE = 3, 40

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>|<[/!?A-Za-z][^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul", "caption",
}
#: Elements whose text is never the article's.
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "head", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar", "status"}
#: Words in a class or id that mark such text.
MARKS = {
    "ad", "ads", "adbox", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "popup", "modal", "overlay", "alert", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "share",
    "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "footer", "masthead", "copyright", "widget",
    "pagination", "pager", "toolbar", "skip", "tags", "header", "topbar", "toc", "disclaimer", "feedback", "responses",
}
HOLDERS = {"article", "main"}
#: Elements that such a word can exclude from inside an article.
BOXES = {"div", "section", "ul", "ol", "dl", "table", "details", "figure"}
# elements that a new block ends by itself
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "option", "optgroup", "body", "html", "tbody", "thead", "tfoot", "caption", "legend", "summary"}


def outside(name: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element with this start tag holds no article text. inside: it stands in an article, where only boxes are told by whole words of their class or id."""
    if name in OUTSIDE and not (inside and name == "header"):
        return True
    if not attributes or attributes.isspace():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main") and not (name == "article" and value in ("article", "main")):
            if inside and name in BOXES and MARKS & set(value.split()) or not inside and MARKS & set(re.split(r"[^a-z]+", re.sub(r"\d+", " ", value))):
                return True
    return False


def lines(html: str) -> list[tuple[str, bool, int]]:
    """(text, whether it is outside the article, number of the article or main element it is in or 0) per block, in order."""
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, outside, holder
    text: list[str] = []
    holders = 0
    lost = False

    def flush() -> None:
        if text:
            line = " ".join(references.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, bool(stack) and stack[-1][1], stack[-1][2] if stack else 0))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        text.append(html[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if name in RAW and not closing:
            stop = RAW_END[name].search(html, at)
            at = stop.end() if stop else end
            if name == "textarea":
                text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if closing:
            if name in BLOCK or any(x[0] == name for x in stack[-8:]):
                close(name)
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "menu", "dl", "table", "select", "tbody", "div", "article", "main"):
                    break
        above = stack[-1] if stack else ("", False, 0)
        lost = above[1] or outside(name, attributes, above[2] > 0 and name != "article")
        holder = above[2]
        if not holder and (name in HOLDERS or re.search(r"""role\s*=\s*["']?main""", attributes, re.I)):
            holders += 1
            holder = holders
        if name in BLOCK or lost != above[1] or holder != above[2]:
            if name not in BLOCK:
                flush()
            stack.append((name, lost, holder))
        else:
            stack.append((name, above[1], above[2]))
    flush()
    return out


def stretch(lengths: list[int]) -> tuple[int, int] | None:
    """[surge, dive) of lines: from the first window whose sum reaches SURGE to the end of the last one; none if none does."""
    sums = [sum(lengths[i : i + WINDOW]) for i in range(max(1, len(lengths) - WINDOW + 1))]
    high = [i for i, x in enumerate(sums) if x >= SURGE]
    return (high[0], min(len(lengths), high[-1] + WINDOW)) if high else None


def main_text(html: str | None) -> str:
    """The article's text, one line per block."""
    if not html:
        return ""
    found = [(text, holder) for text, gone, holder in lines(html) if not gone]
    parts: dict[int, list[str]] = {}
    for text, holder in found:
        parts.setdefault(holder, []).append(text)
    high = {h: s for h, own in parts.items() if (s := stretch([len(t) for t in own]))}
    mass = {h: sum(len(t) for t in parts[h][lo:hi]) for h, (lo, hi) in high.items()}
    best = max(mass, key=lambda h: (mass[h], -h), default=None)
    if best is None:
        kept = [text for text, holder in found if holder or len(parts) == 1] or [text for text, _ in found]
    elif best:
        kept = [text for text, holder in found if holder and holder in high]
    else:
        kept = parts[0][slice(*high[0])]
    return "\n".join(kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_run, SCHEMA)
