"""Paragraphs that most pages of a site share, by an index of substrings.

A paragraph's probe is its opening; the question is how many other texts of the site hold it
anywhere. Texts and probes are cut into overlapping grams, and of each window of grams the one
with the least hash is an anchor: a text that holds a probe has the probe's least gram as an
anchor. So a probe can stand in SHARE of a site's texts only if its least gram is an anchor of as
many, and a site has few such grams: at most one text's anchors over SHARE. Where one of
them stands in a text, the text's characters that a probe would have there are counted as
they are, so the count is exact. Work is in proportion to text and hits, and no step puts
a site's texts or probes into one task: per site there is one row of grams, then one of openings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from .batches import give_back, pieces

SHARE, SHORT, PROBE = 0.6, 20, 100
#: Characters of a gram, and grams of a window.
GRAM, WINDOW = 8, 13
#: Openings at least this long have a whole window; shorter ones are looked up by all substrings of their length.
INDEXED = GRAM + WINDOW - 1
#: A gram's place in an opening and the opening's length are kept in one number.
LENGTHS = 128
#: Rows that a task gives at a time, pages of a site that meet its row in one group, and grams of indexes that a task keeps.
HELD, TOGETHER, KEPT = 20_000, 500, 100_000
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(GRAM)], np.uint64)


def gram_hashes(text: str) -> np.ndarray:
    """A hash of each run of GRAM characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k, factor in enumerate(_FACTORS):
        h += (codes[k : k + n] + np.uint64(1)) * factor
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The distinct least hashes of all windows."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, span = hashes, 1
    while span * 2 <= WINDOW:
        least, span = np.minimum(least[: len(least) - span], least[span:]), span * 2
    return np.unique(np.minimum(least[:n], least[WINDOW - span : WINDOW - span + n]))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), T.trimmed), lambda p: p != "")


def _probe(p: Column) -> Column:
    return F.when(F.length(p) >= SHORT, F.substring(T.collapsed(p), 1, PROBE))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """site, body to site, gram: the anchors of each text."""
    for batch in pieces(batches, 1):
        own = [anchors(gram_hashes(body)) for body in batch.column(1).to_pylist()]
        at = np.repeat(np.arange(len(own)), [len(x) for x in own])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], names=["site", "gram"])
    give_back()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """site, probes to site, gram, spot (place of a probe's least gram in it and the probe's length; of short ones the length, without gram)."""
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            some, keys = batch.slice(start, TOGETHER), set()
            for row, probes in enumerate(some.column(1).to_pylist()):
                for p in set(probes):
                    if len(p) < INDEXED:
                        keys.add((row, None, len(p)))
                    else:
                        h = gram_hashes(p)
                        at = int(h.argmin())
                        keys.add((row, int(h[at]), at * LENGTHS + len(p)))
            rows, grams, spots = zip(*keys, strict=True) if keys else ((), (), ())
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows, pa.int64())), pa.array(grams, pa.int64()), pa.array(spots, pa.int32())], names=["site", "gram", "spot"])
    give_back()


def openings_in(body: str, index: dict[int | None, list[int]], keys: np.ndarray) -> set[str]:
    """What stands in a text where an opening with an indexed gram would stand."""
    found = set()
    h = gram_hashes(body)
    for at in np.flatnonzero(np.isin(h, keys)).tolist():
        for spot in index[int(h[at])]:
            place, length = divmod(spot, LENGTHS)
            start = at - place
            if 0 <= start <= len(body) - length:
                found.add(body[start : start + length])
    for length in index.get(None, ()):
        found.update(body[k : k + length] for k in range(len(body) - length + 1))
    return found


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """site, n_site, body, index to site, n_site, probe: what a text may hold of the site's openings, each once."""
    known, size = {}, 0  # indexes of the last sites, as sites may take turns
    for batch in pieces(batches, 2):
        sites, ns, probes = [], [], []
        entries = batch.column(3)
        for k, (site, n, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if site not in known:
                index = {e["gram"]: e["spots"] for e in entries[k].as_py()}
                if size + len(index) > KEPT:
                    known, size = {}, 0
                known[site] = index, np.array([g for g in index if g is not None], np.int64)
                size += len(index)
            own = list(openings_in(body, *known[site]))
            for start in range(0, len(own), HELD):
                some = own[start : start + HELD]
                probes += some
                sites += [site] * len(some)
                ns += [n] * len(some)
                if len(probes) >= HELD:
                    yield _probes(sites, ns, probes)
                    sites, ns, probes = [], [], []
        yield _probes(sites, ns, probes)
    give_back()


def _probes(sites: list[str], ns: list[int], probes: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(ns, pa.int64()), pa.array(probes, pa.string())], names=["site", "n_site", "probe"])


def _parts() -> Column:
    return F.ceil(F.col("n_site") / TOGETHER).cast("int")


def _part() -> Column:
    """A page's part of its site, by its number."""
    return F.pmod(F.xxhash64("page_id"), _parts()).cast("int")


def _copied(sites: DataFrame) -> DataFrame:
    """A row of each site for every part of it."""
    return sites.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1)))


def shared_openings(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """site, openings: a map from the openings of paragraphs that SHARE of a site's texts hold to how many do. pages: site, page_id, text; sizes: site, n_site."""
    own = pages.select("site", "page_id", T.collapsed(F.col("text")).alias("body"))
    several, enough = sizes.where("n_site > 1"), F.col("held") >= F.floor(F.col("n_site") * SHARE)
    # most grams stand in one text: they are counted as plain numbers, and only the few that are left meet the openings
    often = own.select("site", "body").mapInArrow(_anchors, "site string, gram long").groupBy("site", "gram").agg(F.count("*").alias("held")).join(several, "site").where(enough).select("site", "gram")
    probes = pages.select("site", F.array_compact(F.transform(_paragraphs(F.col("text")), _probe)).alias("probes")).mapInArrow(_entries, "site string, gram long, spot int")
    spots = stored(probes.groupBy("site", "gram", "spot").agg(F.count("*").alias("n")).select("site", "gram", "spot"), "spots")
    kept = spots.join(often, ["site", "gram"]).unionByName(spots.where("gram is null"))
    index = kept.groupBy("site", "gram").agg(F.collect_set("spot").alias("spots")).join(several, "site").groupBy("site", "n_site").agg(F.collect_list(F.struct("gram", "spots")).alias("index"))
    # a copy of the site's row for each TOGETHER of its texts, so that the texts of a large site spread over tasks
    found = own.select("site", "body", "page_id").join(sizes, "site").select("site", "body", _part().alias("part")).join(_copied(index), ["site", "part"]).select("site", "n_site", "body", "index").mapInArrow(_held, "site string, n_site long, probe string")
    counted = found.groupBy("site", "n_site", "probe").agg(F.count("*").alias("held")).where(enough)
    return counted.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("probe", "held"))).alias("openings"))


def main_content(texts: DataFrame) -> DataFrame:
    """site, page_id, url, text, main_text: without paragraphs that most other pages of the site have too.

    The text of a page and texts equal to it don't count as others. Paragraphs below SHORT
    characters stay, as does all of a site's only page.
    """
    pages = stored(texts.select("site", "page_id", "url", "text", F.unhex(F.sha2("text", 256)).alias("digest")), "texts")
    sizes = pages.groupBy("site").agg(F.count("*").alias("n_site"))
    sites = sizes.join(shared_openings(pages, sizes), "site", "left")
    same = pages.groupBy("site", "digest").agg(F.count("*").alias("n_same"))
    known = pages.join(same.join(sizes, "site"), ["site", "digest"]).withColumn("part", _part()).drop("n_site")
    wide = known.join(_copied(sites), ["site", "part"])
    bar = F.ceil((F.col("n_site") - F.col("n_same")) * SHARE)
    # a page's own text holds its paragraph, as do its equals
    held = lambda p: F.coalesce(F.try_element_at("openings", _probe(p)), F.lit(0)) - F.col("n_same")
    # without shared openings nothing is looked up
    stays = lambda p: (F.col("n_site") == 1) | F.col("openings").isNull() | (F.length(p) < SHORT) | (held(p) < bar)
    out = wide.select("site", "page_id", "url", "text", F.array_join(F.filter(_paragraphs(F.col("text")), stays), "\n\n").alias("main_text"))
    # a set number of partitions: few bytes mustn't merge into one task, which all that reads the table would inherit
    return out.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site", "page_id")
