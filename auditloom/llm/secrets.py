"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

A token that no pattern explains is tested for being uniformly random in the encoding
inferred for it: chi-squared on its symbols by kind (digits, vowels and consonants, small and
capital, others), a runs test, and lag-one serial correlation. Fisher's method joins the three
p-values. What ordinary tokens of the corpus would get is learned from decoys: beside each
token one of its length, case and separators is made of the words around it and tested too.
Within each class of lengths, the tokens that look random least (there random ones hardly
ever lie) tell how many are ordinary, and a step-up over all tokens of the corpus takes the
laxest bound at which ordinary ones, by the decoys' share below it, make up at most RATE of the
tokens that are reported as spans of kind `random`. Where no bound does, none is reported.

Results in special cases: a null text counts as empty and has no spans; a token that fits no
encoding or has fewer than 16 symbols is not tested, a very long one is tested whole; tokens
that tie are all reported or none; repeated rows each give a row; an empty table gives an
empty one; columns other than doc_id and text are not read. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Upper ends of the length classes, and the share of ordinary tokens among those reported in each.
LENGTHS, RATE = (20, 24, 32, 40, 64, 1 << 62), 0.05
#: From this bin on (p below a hundredth) tokens count as ordinary.
ORDINARY = 200
#: Code points around a token whose words make its decoy, and words where there are none.
AROUND, WORDS = 200, ("some", "page", "about", "things", "that", "happened", "later")
#: p-values are binned by hundredths of their decimal logarithm, down to 10**-30.
BINS = 3000

DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("hex", DIGITS + "ABCDEF"),
    ("base32", UP + "234567"),
    ("base36", DIGITS + LOW),
    ("base36", DIGITS + UP),
    ("base64", UP + LOW + DIGITS + "+/"),
    ("base64url", UP + LOW + DIGITS + "-_"),
)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,label:string>>, tokens array<struct<start:long,kind:int,label:string,length:long,bin:int,decoy:int>>"


KIND = {c: k for k, letters in enumerate((DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ")) for c in letters}


def encoding(token: str) -> tuple[str, str] | None:
    """The smallest alphabet that holds the token, or none."""
    symbols = set(token.rstrip("="))
    return next(((name, letters) for name, letters in ENCODINGS if symbols <= set(letters)), None)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(body: str, letters: str) -> float:
    """p-value of the counts of symbols by kind, kinds that are expected less than twice going together (Wilson-Hilferty)."""
    expected, seen = [0.0] * 6, [0] * 6
    for c in letters:
        expected[KIND.get(c, 5)] += len(body) / len(letters)
    for c in body:
        seen[KIND.get(c, 5)] += 1
    groups, rest = [], [0.0, 0]
    for e, s in zip(expected, seen, strict=True):
        if e >= 2:
            groups.append((e, s))
        else:
            rest = [rest[0] + e, rest[1] + s]
    if rest[0] > 0:
        groups.append((max(rest[0], 0.5), rest[1]))
    x, free = sum((s - e) ** 2 / e for e, s in groups), max(1, len(groups) - 1)
    z = ((x / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(index: list[int], size: int) -> float:
    """p-value of the Wald-Wolfowitz runs test about the middle of the alphabet."""
    above = [2 * k >= size for k in index]
    high, low = sum(above), len(above) - sum(above)
    n = high + low
    if not high or not low:
        return 10.0**-30
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return normal_tail((1 + sum(a != b for a, b in zip(above, above[1:], strict=False)) - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def serial(index: list[int]) -> float:
    """p-value of the lag-one correlation of symbol ranks."""
    n = len(index)
    mean = sum(index) / n
    spread = sum((k - mean) ** 2 for k in index)
    if not spread:
        return 10.0**-30
    r = sum((a - mean) * (b - mean) for a, b in zip(index, index[1:], strict=False)) / spread
    return normal_tail((r + 1 / n) * math.sqrt(n))


def battery(token: str) -> float | None:
    """Fisher's combined p-value that the token is uniformly random in its encoding; none if it has no encoding or is short."""
    body, found = token.rstrip("="), encoding(token)
    if not found or len(body) < 16:
        return None
    rank = {c: k for k, c in enumerate(found[1])}
    index = [rank[c] for c in body]
    half = -sum(math.log(max(p, 1e-30)) for p in (chi_squared(body, found[1]), runs(index, len(rank)), serial(index)))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def decoy(token: str, around: str) -> str:
    """An ordinary token of the same length: words of the text around, with the token's case, separator and up to four of its digits."""
    body = token.rstrip("=")
    upper, lower = any(c in UP for c in body), any(c in LOW for c in body)
    between = next((c for c in "-_/+" if c in body), "")
    words = [w for w in re.findall("[A-Za-z]{2,}", around) if w not in body] or list(WORDS)
    words = [w.upper() if upper and not lower else w.capitalize() if upper else w.lower() for w in words]
    made = between.join(words)
    made = (made + between) * (len(body) // len(made) + 1)
    tail = "".join(c for c in body if c in DIGITS)[:4]
    return made[: len(body) - len(tail)] + tail


def binned(p: float) -> int:
    return min(BINS, int(-math.log10(max(p, 1e-30)) * 100))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def label(start: int, kind: int, end: int) -> str:
    return f"{KINDS[kind]}:{start}:{end}"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("label", pa.string())]))), ("tokens", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("label", pa.string()), ("length", pa.int64()), ("bin", pa.int32()), ("decoy", pa.int32())])))])
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            base = base_spans(text)
            tokens, k, reach = [], 0, 0
            for m in TOKEN.finditer(text):
                s, e = m.span()
                # base spans are in order: all that begin before the token's end have been passed by once
                while k < len(base) and base[k][0] < e:
                    reach = max(reach, base[k][2])
                    k += 1
                if reach > s:
                    continue
                p = battery(m[0])
                if p is not None:
                    q = battery(decoy(m[0], text[max(0, s - AROUND) : s] + " " + text[e : e + AROUND]))
                    tokens.append({"start": s, "kind": 3, "label": label(s, 3, e), "length": e - s, "bin": binned(p), "decoy": None if q is None else binned(q)})
            labels = [label(*x) for x in base]
            rows.append((doc, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(",".join(labels).encode()).hexdigest(), [{"start": x[0], "kind": x[1], "label": n} for x, n in zip(base, labels, strict=True)], tokens))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t.type) for t in kinds], schema=kinds)


def bounds(histogram: list[tuple[int, bool, int, int]]) -> list[int]:
    """Per length class the bin below which tokens are reported, from counts by (class, whether of a decoy, bin)."""
    out = []
    for k in range(len(LENGTHS)):
        tokens, decoys = ({b: n for c, d, b, n in histogram if c == k and d == of} for of in (False, True))
        far = lambda x: sum(n for b, n in x.items() if b >= ORDINARY)
        all_, made = sum(tokens.values()), max(1, sum(decoys.values()))
        # decoys show which share of ordinary tokens lies far out
        ordinary = min(all_, (far(tokens) + 1) * made / far(decoys)) if far(decoys) else all_
        cut, seen, false = 0, 0, 0
        for b in range(ORDINARY):
            seen += tokens.get(b, 0)
            false += decoys.get(b, 0)
            if seen and ordinary * (false + 1) / made <= RATE * seen:
                cut = b + 1
        out.append(cut)
    return out


def secret_scan(documents: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans."""
    found = materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scan, SCHEMA), "secrets")
    of_class = lambda length: F.coalesce(*(F.when(length < end, F.lit(k)) for k, end in enumerate(LENGTHS)))
    both = found.select(F.explode("tokens").alias("t")).select(of_class(F.col("t.length")).alias("c"), F.explode(F.array(F.struct(F.lit(False).alias("d"), F.col("t.bin").alias("b")), F.struct(F.lit(True).alias("d"), F.col("t.decoy").alias("b")))).alias("x"))
    # bounded: length classes times bins, twice
    histogram = both.where("x.b is not null").groupBy("c", "x.d", "x.b").count().collect()
    cuts = bounds([(r["c"], r["d"], r["b"], r["count"]) for r in histogram])

    def random(t):
        return t["bin"] < F.coalesce(*(F.when(t["length"] < end, F.lit(cuts[k])) for k, end in enumerate(LENGTHS)))

    added = F.transform(F.filter("tokens", random), lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["label"].alias("label")))
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", added)), lambda x: x["label"]), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(added).cast("long").alias("n_random"))
