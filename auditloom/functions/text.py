"""Text expressions: from markup to text, white space, words and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions have it.
WS = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: From markup to text, in order; without back-references or look-around.
MARKUP = (
    ("(?is)<!--.*?-->", ""),
    ("(?is)<head[^>]*>.*?</head>", ""),
    ("(?is)<script[^>]*>.*?</script>", ""),
    ("(?is)<style[^>]*>.*?</style>", ""),
    (r"(?i)</?(?:p|h[1-6]|ul|ol)(?:\s[^>]*)?>", "\n\n"),
    (r"(?i)</?(?:div|li|nav|article|footer|header|section|main|tr|table)(?:\s[^>]*)?>|<br\s*/?>", "\n"),
    ("<[^>]*>", ""),
)
#: Character references, &amp; last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Phrases that fill space, and units of ten to thirty characters of one line, four times or more in a row.
FILLER_ZH = "总之|综上所述|总的来说|简单来说|众所周知|毫无疑问|显而易见"
FILLER_EN = "(?i)in conclusion|as we all know|it goes without saying|needless to say"
FILLER_REPEAT = r"([^\n\r\u2028\u2029]{10,30})\1{3,}"
GRAM, LEAST_GRAMS = 4, 3
SKELETON = 1000


def decoded(text: Column) -> Column:
    for a, b in REFERENCES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def visible(html: Column) -> Column:
    """The text a reader sees, near enough: layout isn't computed."""
    for pattern, by in MARKUP:
        html = F.regexp_replace(html, pattern, by)
    return decoded(html)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def solid_length(text: Column) -> Column:
    """Code points that are no white space."""
    return F.length(F.regexp_replace(text, f"{WS}+", "")).cast("long")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def words(text: Column) -> Column:
    """Words in lower case; those of one character are left out."""
    return F.filter(F.split(F.lower(text), f"{WS}+"), lambda w: F.length(w) > 1)


def grams(own: str) -> Column:
    """4-grams of a column of words, in order; of fewer than four words the words themselves.

    The words must be a column: an expression would be evaluated again for every gram.
    """
    at = F.sequence(F.lit(1), F.size(own) - (GRAM - 1))
    return F.when(F.size(own) < GRAM, F.col(own)).otherwise(F.transform(at, lambda i: F.array_join(F.slice(own, i, GRAM), " ")))


def skeleton(text: Column) -> Column:
    """Runs of letters as W, of digits as N, single spaces; the first thousand characters."""
    shape = F.regexp_replace(F.regexp_replace(text, r"[a-zA-Z一-鿿]+", "W"), "[0-9]+", "N")
    return F.substring(F.regexp_replace(shape, f"{WS}+", " "), 1, SKELETON)


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("long")
