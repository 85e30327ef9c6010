"""What a page's own style sheets say about its elements, without a browser.

The rules of inline style elements become rows (page, key, order, declarations), the elements of the
markup rows (page, key); the key is the tag, a class or the id, so they meet in an equi-join.
Selectors count that name one element by tag, class, id or tag and class or id; conditions
of @media blocks and combinators are left out, and nothing is inherited. Of several
declarations of a property the one with the highest rank wins: the element's style attribute, then id,
class, tag, then the later rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose letters are looked at, the least size in pixels, and names of what covers a page.
LETTERS, LEAST_FONT = ("p", "span", "a", "li"), 12
COVERS_CLASS, COVERS_ID = "modal|popup|overlay", "modal|popup"
#: A frame of this size or less in pixels can't be seen.
TINY = 50
SIMPLE = r"^([a-zA-Z][a-zA-Z0-9]*)?(?:([.#])([A-Za-z_-][A-Za-z0-9_-]*))?$"
PROPERTIES = ("font-size", "display", "visibility", "opacity", "width", "height")


def _bare(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), "(?is)<script[^>]*>.*?</script>", "")


def _declared(text: Column, name: str) -> Column:
    """The last value of a property in a list of declarations, or null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:^|[;{{\s]){name}\s*:\s*([^;!}}]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def pixels(value: Column) -> Column:
    """A length in pixels: px, pt, em and rem (16 pixels each), or a bare number; else null."""
    number = F.regexp_extract(value, r"^([0-9]*\.?[0-9]+)(?:px|pt|r?em)?$", 1).try_cast("double")
    return F.when(value.rlike("pt$"), number * 4 / 3).when(value.rlike("em$"), number * 16).otherwise(number)


def rules(pages: DataFrame) -> DataFrame:
    """page_id, key, tag, rank, body: the simple selectors of a page's style elements; rank grows with specificity, then order."""
    css = F.array_join(F.regexp_extract_all(_bare(F.col("html")), F.lit("(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")
    css = F.regexp_replace(css, r"(?s)/\*.*?\*/", "")
    group = lambda k: F.regexp_extract_all(css, F.lit(r"([^{};]+)\{([^{}]*)\}"), F.lit(k))
    each = pages.select("page_id", F.posexplode(F.arrays_zip(group(1).alias("s"), group(2).alias("b"))).alias("at", "r"))
    one = each.select("page_id", "at", F.col("r.b").alias("body"), F.explode(F.split("r.s", ",")).alias("s")).withColumn("s", F.trim(F.regexp_replace("s", r"\s+", " "))).where((F.col("s") != "") & F.col("s").rlike(SIMPLE))
    tag, kind, name = F.lower(F.regexp_extract("s", SIMPLE, 1)), F.regexp_extract("s", SIMPLE, 2), F.regexp_extract("s", SIMPLE, 3)
    key = F.when(kind == "", F.concat(F.lit("<"), tag)).otherwise(F.concat(kind, name))
    weight = F.when(kind == "#", 100).when(kind == ".", 10).otherwise(0) + F.when(tag != "", 1).otherwise(0)
    return one.select("page_id", key.alias("key"), tag.alias("tag"), (weight.cast("long") * 1_000_000 + F.col("at")).alias("rank"), "body")


def elements(pages: DataFrame) -> DataFrame:
    """page_id, at, tag, classes, id, body (the style attribute), width, height: the elements that some rule here asks about."""
    own = lambda name: F.concat(*(F.regexp_extract("t", rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", k) for k in (1, 2, 3)))
    tags = F.regexp_extract_all(_bare(F.col("html")), F.lit(r"(?is)<[a-z][a-z0-9]*(?:\s[^>]*)?>"), F.lit(0))
    df = pages.select("page_id", F.posexplode(tags).alias("at", "t"))
    df = df.select("page_id", "at", F.lower(F.regexp_extract("t", "^<([A-Za-z0-9]+)", 1)).alias("tag"), own("class").alias("c"), own("id").alias("id"), own("style").alias("body"), own("width").alias("width"), own("height").alias("height"))
    asked = F.col("tag").isin(*LETTERS, "iframe") | F.col("c").rlike(COVERS_CLASS) | F.col("id").rlike(COVERS_ID)
    return df.where(asked).withColumn("classes", F.array_distinct(F.filter(F.split("c", r"\s+"), lambda x: x != ""))).drop("c")


def styled(pages: DataFrame) -> DataFrame:
    """elements() with the winning value of each of PROPERTIES (null where nothing sets it)."""
    el = elements(pages)
    keys = F.concat(F.array(F.concat(F.lit("<"), "tag")), F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.when(F.col("id") != "", F.array(F.concat(F.lit("#"), "id"))).otherwise(F.array().cast("array<string>")))
    met = el.select("page_id", "at", F.col("tag").alias("own_tag"), F.explode(keys).alias("key")).join(rules(pages), ["page_id", "key"]).where((F.col("tag") == "") | (F.col("tag") == F.col("own_tag"))).select("page_id", "at", "rank", "body")
    inline = el.where("body <> ''").select("page_id", "at", F.lit(10**15).alias("rank"), "body")
    won = [F.max(F.when(_declared(F.col("body"), p).isNotNull(), F.struct("rank", _declared(F.col("body"), p).alias("v")))).alias(p) for p in PROPERTIES]
    best = met.unionByName(inline).groupBy("page_id", "at").agg(*won)
    values = best.select("page_id", "at", *(F.col(f"`{p}`.v").alias(f"css_{p.replace('-', '_')}") for p in PROPERTIES))
    return el.drop("body").join(values, ["page_id", "at"], "left")


def page_styles(pages: DataFrame) -> DataFrame:
    """Per page: whether letters below LEAST_FONT pixels are set, what may cover the page and isn't hidden, and frames that can't be seen."""
    c = F.col
    hidden = F.coalesce(c("css_display") == "none", F.lit(False)) | F.coalesce(c("css_visibility") == "hidden", F.lit(False))
    font = pixels(c("css_font_size"))
    small = c("tag").isin(*LETTERS) & F.coalesce((font > 0) & (font < LEAST_FONT), F.lit(False))
    covers = (F.array_join("classes", " ").rlike(COVERS_CLASS) | c("id").rlike(COVERS_ID)) & ~hidden & ~F.coalesce(c("css_opacity").try_cast("double") == 0, F.lit(False))
    side = lambda name: F.coalesce(pixels(c(f"css_{name}")), pixels(c(name))) <= TINY
    unseen = (c("tag") == "iframe") & (hidden | F.coalesce(side("width"), F.lit(False)) | F.coalesce(side("height"), F.lit(False)))
    found = styled(pages).groupBy("page_id").agg(F.count_if(small).alias("n_small"), F.count_if(covers).alias("popups"), F.count_if(unseen).alias("unseen_frames"))
    n = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    return pages.select("site", "page_id").join(found, "page_id", "left").select("site", "page_id", n("n_small").alias("small_letters"), n("popups").alias("popups"), n("unseen_frames").alias("unseen_frames"))
