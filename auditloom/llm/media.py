"""Media columns: documents as ordered sequences of texts and media references, and the payloads they refer to.

A document's HTML is parsed to an array of structs in page order, texts and references alike; a
reference has the digest of what it refers to and the caption of its figure. Payloads are kept once written in
a table by digest, their features are computed there, and references meet features by a join on the
digest: only digests and features are shuffled, never payloads. AQE splits the join's task of a digest
that many documents refer to. A reference that nothing is stored for keeps its place, with a null medium.

Bytes are stored as a grey picture of 64 samples a line, 8 bits each (PGM); its comment tells how many
bytes are no filling. Null counts as empty, and an empty text is one line of zeros. Repeated rows and
repeated or missing ids each keep a row of their own. Empty tables give empty ones; a text is handled whole
whatever its length. Other columns pass through or are dropped; none can clash, since sequences() refuses a name that is taken.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import materialise, text_of

LINE = 64
SCHEME = "media:"
ITEM = "struct<position: int, kind: string, text: string, src: string, digest: string, caption: string>"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

#: Elements that end a run of text.
BLOCKS = frozenset("address article aside blockquote br body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
MEDIA = frozenset("img audio video source embed".split())
SILENT = frozenset("script style template noscript".split())


class _Sequence(HTMLParser):
    """Texts and media references of a page in order; a figure's caption goes to all its references."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items, self.run, self.silent, self.figures, self.caption = [], [], 0, [], None

    def _end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag == "figcaption":
            self._end_run()
            self.caption = []
        elif tag in BLOCKS and self.caption is None:
            self._end_run()
            if tag == "figure":
                self.figures.append([])
        if tag in MEDIA and self.caption is None:
            own = dict(attrs)
            src = (own.get("src") or "").strip()
            if src:
                self._end_run()
                self.items.append({"kind": "media", "text": None, "src": src, "digest": digest_of(src), "caption": own.get("alt") or own.get("title")})
                if self.figures:
                    self.figures[-1].append(self.items[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figures:
                self.figures[-1].append(text)
            elif text:
                self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})
        elif tag in BLOCKS and self.caption is None:
            self._end_run()
            if tag == "figure" and self.figures:
                self._close_figure()

    def _close_figure(self) -> None:
        own = self.figures.pop()
        text = " ".join(x for x in own if isinstance(x, str) and x)
        found = [x for x in own if isinstance(x, dict)]
        for x in found:
            x["caption"] = text or x["caption"]
        if text and not found:
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)

    def ended(self) -> list[dict]:
        self.close()
        if self.caption is not None:
            self.handle_endtag("figcaption")
        self._end_run()
        while self.figures:
            self._close_figure()
        return [x | {"position": k} for k, x in enumerate(self.items)]


def digest_of(src: str) -> str | None:
    """The SHA-256 that a reference names (media:...) or whose bytes it holds itself (data:...)."""
    if src.startswith(SCHEME):
        return src[len(SCHEME) :].lower()
    if src[:5].lower() != "data:":
        return None
    head, comma, body = src[5:].partition(",")
    if not comma:
        return None
    try:
        held = base64.b64decode(urllib.parse.unquote_to_bytes(body)) if head.rstrip().lower().endswith(";base64") else urllib.parse.unquote_to_bytes(body)
    except (ValueError, binascii.Error):
        return None
    return hashlib.sha256(held).hexdigest()


def parsed(html: str | None) -> list[dict]:
    """The items of a page in order."""
    reader = _Sequence()
    reader.feed(html or "")
    return reader.ended()


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with its markup replaced by sequence: texts and media references in page order, positions from 0."""
    if "sequence" in (c.lower() for c in pages.columns if c != html):
        raise ValueError("the table has a column named sequence already")
    kept = [c for c in pages.columns if c != html]
    schema = S.StructType([*(pages.schema[c] for c in kept), S.StructField("sequence", S._parse_datatype_string(f"array<{ITEM}>"))])
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "src", "digest", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([parsed(x.as_py()) for x in batch.column(html)], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=[*kept, "sequence"])

    return pages.mapInArrow(run, schema)


def picture(data: Column) -> Column:
    """Bytes as a PGM picture: a comment with their number, lines of 64 samples, zeros up to the last line's end."""
    n = F.octet_length(data)
    lines = F.greatest(F.lit(1), F.ceil(n / LINE)).cast("long")
    head = F.concat(F.lit("P5\n# "), n.cast("string"), F.lit(f" bytes\n{LINE} "), lines.cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), data, F.unhex(F.repeat(F.lit("00"), (lines * LINE - n).cast("int"))))


def samples(stored: memoryview) -> tuple[int, memoryview]:
    """(bytes that are no filling, samples) of a stored picture."""
    found = re.match(rb"P5\n# ([0-9]+) bytes\n([0-9]+) ([0-9]+)\n255\n", stored[:128])
    if not found:
        raise ValueError("no picture of bytes")
    n, width, lines = map(int, found.groups())
    held = stored[found.end() :]
    if len(held) != width * lines or n > len(held):
        raise ValueError("the picture isn't whole")
    return n, held


def feature_of(held: memoryview) -> str:
    """Width x lines, the mean sample, and a bit for each column whose mean is above it."""
    table = np.frombuffer(held, np.uint8).reshape(-1, LINE)
    sums = table.sum(axis=0, dtype=np.int64)
    above = np.packbits(sums * LINE > sums.sum())
    return f"{LINE}x{len(table)} {sums.sum() / table.size:.4f} {above.tobytes().hex()}"


def features(store: DataFrame) -> DataFrame:
    """digest and FEATURES, once a digest: of the bytes of a table (digest, media) as they are read back."""
    names = ["digest", *(c.split()[0] for c in FEATURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = memoryview(media.as_buffer())
                n, held = samples(stored)
                rows.append((digest, n, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-LINE:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(held)))
            if rows:
                columns = zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

    return store.select("digest", "media").mapInArrow(run, f"digest string, {FEATURES}").dropDuplicates(["digest"])


def resolved(documents: DataFrame, media: DataFrame) -> DataFrame:
    """One row an item of sequences(): the document's other columns, item, medium (what media has for its digest, or null)."""
    kept = [c for c in documents.columns if c != "sequence"]
    items = documents.select(*(f"`{c}`" for c in kept), F.explode("sequence").alias("item"))
    known = media.select(F.col("digest").alias("of_digest"), F.struct(*(c for c in media.columns if c != "digest")).alias("medium"))
    # texts have no digest: each gets a key of its own, or all would meet in one task
    key = F.coalesce(F.col("item.digest"), F.concat(F.lit("-"), F.xxhash64("item").cast("string")))
    return items.withColumn("of_digest", key).join(known, "of_digest", "left").drop("of_digest")


def aligned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """resolved() rows back to one a document: keys and items, in order, each with its medium."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("item.position").alias("position"), "item", "medium"))).alias("items"))


def media_columns(documents: DataFrame) -> DataFrame:
    """Per document: its text stored as a picture, found again from the document's markup, read back and described."""
    df = documents.select(F.col("doc_id"), picture(text_of().cast("binary")).alias("media"))
    store = materialise(df.withColumn("digest", F.sha2("media", 256)), "media")
    figure = F.concat(F.lit("<p>Text of a document, as samples:</p><figure><img src='media:"), "digest", F.lit("'><figcaption>"), F.coalesce(F.col("doc_id").cast("string"), F.lit("no number")), F.lit("</figcaption></figure>"))
    references = resolved(sequences(store.select("doc_id", figure.alias("html"))), features(store)).where("item.kind = 'media'")
    return references.select("doc_id", "medium.*")
