"""URL expressions: parts, normal form, page types, dates in paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path rules of the page types.
REQUIRED = "/about|/privacy|/contact|/terms|/legal|/editorial-policy|/imprint"
UTILITY = "/download|/search|/login|/signup|/register|/sitemap|/404"
DETAIL = {
    "content": "blog|news|guides|articles|posts|tutorials",
    "game_detail": "games|game|play|online-games",
    "video_detail": "videos|video|watch|v|shorts|clip|stream",
    "reference_detail": "wiki|reference|docs|encyclopedia|glossary|knowledge|archive|database|transcript",
}
LISTING = "blog|news|guides|articles|games|play|videos|watch|channels|categories|tags|archive"
STATIC = "xml|txt|json|pdf|zip|tar|gz|rar|exe|dmg|apk|css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot"
TECHNICAL = r"/ads\.txt|/robots\.txt|/sitemap\.xml|/favicon\.ico|/manifest\.json|/sw\.js|/service-worker\.js|/humans\.txt|/security\.txt|/\.well-known"
SAMPLING_WEIGHTS = {"homepage": 10, "content": 8, "game_detail": 8, "video_detail": 8, "reference_detail": 8, "required": 7, "listing": 4, "reference_listing": 4, "utility": 2, "unknown": 3}
SCORE_WEIGHTS = {"homepage": 1.5, "content": 1.0, "game_detail": 1.0, "video_detail": 1.0, "reference_detail": 1.0, "unknown": 0.5, "required": 0.2, "listing": 0.1, "reference_listing": 0.1, "utility": 0.1}


def site(url: Column) -> Column:
    """The host, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def folded(p: Column) -> Column:
    """A path without dot segments: a fold over its segments, on which two dots drop the segment before; empty segments stay."""
    segments = F.slice(F.split(p, "/"), 2, F.size(F.split(p, "/")))
    one = lambda x: F.replace(F.lower(x), F.lit("%2e"), F.lit(".")) == "."
    two = lambda x: F.replace(F.lower(x), F.lit("%2e"), F.lit(".")) == ".."
    step = lambda done, x: F.when(two(x), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(one(x), done).otherwise(F.concat(done, F.array(x)))
    # a last dot segment leaves its folder: an empty last segment
    ended = F.when(F.element_at(segments, -1).rlike(r"(?i)^(?:\.|%2e){1,2}$"), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    out = F.concat(F.lit("/"), F.array_join(F.aggregate(ended, F.array().cast("array<string>"), step), "/"))
    return F.when(p == "", "/").when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), out).otherwise(p)


def canonical(url: Column) -> Column:
    """An http address as browsers write it: scheme and host in lower case, no default port, a path without dot segments."""
    parts = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(.*)$"
    scheme, host = F.lower(F.regexp_extract(url, parts, 1)), F.lower(F.regexp_extract(url, parts, 2))
    port = F.when(scheme == "http", ":80").otherwise(":443")
    host = F.when(F.endswith(host, port), F.substring_index(host, ":", 1)).otherwise(host)
    return F.when(url.rlike("(?i)^https?://"), F.concat(scheme, F.lit("://"), host, folded(F.regexp_extract(url, parts, 3)), F.regexp_extract(url, parts, 4))).otherwise(url)


def normalised(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def is_content(url: Column) -> Column:
    """Whether the URL can be a page: no static file, no well-known technical path."""
    p = path(url)
    return (site(url) != "") & ~p.rlike(rf"(?i)\.(?:{STATIC})$") & ~p.rlike(rf"(?i)^(?:{TECHNICAL})")


def _detail(p: Column) -> list[tuple[Column, str]]:
    return [(p.rlike(f"^/(?:{names})/."), kind) for kind, names in DETAIL.items()]


def page_type(p: Column) -> Column:
    """The type of a page by the first rule that its path meets."""
    trimmed = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    rest = F.regexp_extract(trimmed, "^/[a-z]{2}(/.*)?$", 1)
    in_language = trimmed.rlike("^/[a-z]{2}(?:/|$)")
    rules = [((p == "") | (p == "/"), "homepage"), (p.rlike(f"(?i){REQUIRED}"), "required"), (p.rlike(f"(?i){UTILITY}"), "utility"), *_detail(trimmed)]
    rules += [(trimmed.rlike(f"^/(?:{DETAIL['reference_detail']})$"), "reference_listing"), (trimmed.rlike(f"^/(?:{LISTING})$"), "listing")]
    rules += [(in_language & (rest == ""), "listing")]
    rules += [(in_language & rest.rlike(f"^/(?:{names})/."), kind) for kind, names in DETAIL.items()]
    rules += [(in_language & rest.rlike(f"^/(?:{names})/?$"), "reference_listing" if kind == "reference_detail" else "listing") for kind, names in DETAIL.items()]
    rules += [(in_language & rest.rlike(f"(?i){REQUIRED}"), "required")]
    out = F.when(*(rules[0][0], F.lit(rules[0][1])))
    for test, kind in rules[1:]:
        out = out.when(test, F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def weight(kind: Column, weights: dict[str, float], default: float) -> Column:
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(default))


def path_date(p: Column) -> Column:
    """The date in a path: a year that no digit follows, with month and day if they do; June and the 15th if not."""
    pattern = r"/(20[12][0-9])(?![0-9])(?:[-/](1[0-2]|0?[1-9])(?![0-9])(?:[-/](3[01]|[12][0-9]|0?[1-9])(?![0-9]))?)?"
    year, month, day = (F.regexp_extract(p, pattern, k) for k in (1, 2, 3))
    part = lambda x, default: F.when(x == "", F.lit(default)).otherwise(F.lpad(x, 2, "0"))
    return F.when(year != "", F.try_to_date(F.concat_ws("-", year, part(month, "06"), part(day, "15")), "yyyy-MM-dd"))
