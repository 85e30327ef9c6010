"""Saved reports: one JSON file a site, written by the tasks that hold the site, and read again with a declared schema.

A file is written as its rows come, so no task holds a site's pages at once. Tasks write into a
folder of their attempt; only when all are done are the files of the successful attempts moved
to their names, so a lost or repeated task leaves nothing behind and no file half written.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "site_reports"
ROWS = "site string, part int, ordinal long, body string"
#: Lists of a file, by the number of the part they come in; part 0 is the head.
LISTS = ("items", "pages")
ITEM = "struct<item: string, bucket: string, status: string>"
PAGE = "struct<page_id: bigint, title: string, page_type: string, lang: string, total_chars: bigint, content_chars: bigint, content_ratio: bigint, content_status: string, issues: string, embed: string, ai_status: string, relevance_label: string, score: bigint, display_status: string>"
HEAD = "struct<vot: double, cap: bigint, n_pages: bigint, type: string>"
SCHEMA = f"site string, report {HEAD}, items array<{ITEM}>, pages array<{PAGE}>, broken string"


def file_name(site: str, stamp: str) -> str:
    """<site>-<stamp>.json; a site that isn't a plain host gets a digest, so that no two share a name, and a first letter, since files that begin with _ or . are hidden from readers."""
    if re.fullmatch("[a-z0-9][a-z0-9.-]*", site):
        return f"{site}-{stamp}.json"
    return f"site{re.sub('[^a-z0-9.-]', '_', site)}-{hashlib.sha256(site.encode()).hexdigest()[:12]}-{stamp}.json"


@dataclasses.dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class SiteReportWriter(DataSourceWriter):
    """Writes rows (ROWS), sorted by site, part and ordinal, as one file a site."""

    def __init__(self, path: str, stamp: str) -> None:
        self.path, self.stamp, self.run = path.rstrip("/"), stamp, uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = self._system()
        folder = f"{root}/_writing-{self.run}/{uuid.uuid4().hex}"
        names, out, site, part = [], None, None, 0

        def close() -> None:
            if out:
                out.write(("]" if part else "").encode() + b"".join(f', "{n}": []'.encode() for n in LISTS[part:]) + b"}")
                out.close()

        for r in rows:
            if out is None or r["site"] != site:
                close()
                if not names:
                    system.create_dir(folder, recursive=True)
                site, part = r["site"], 0
                names.append(file_name(site, self.stamp))
                out = system.open_output_stream(f"{folder}/{names[-1]}")
                out.write(f'{{"site": {json.dumps(site)}'.encode())
            if r["part"] == 0:
                out.write(b', "report": ' + r["body"].encode())
                continue
            first = r["part"] != part
            if first:
                out.write(("]" if part else "").encode() + b"".join(f', "{n}": []'.encode() for n in LISTS[part : r["part"] - 1]) + f', "{LISTS[r["part"] - 1]}": ['.encode())
                part = r["part"]
            out.write(("" if first else ",").encode() + b"\n" + r["body"].encode())
        close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._system()
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._system())

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_writing-{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_writing-{self.run}")


class SiteReports(DataSource):
    """The writer as a format of Spark: options path and stamp."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> SiteReportWriter:
        return SiteReportWriter(self.options["path"], self.options.get("stamp", "report"))


def rows_of(heads: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """ROWS of heads (site, vot, cap, n_pages, type), items (site, item, bucket, status) and page records."""
    body = lambda df: F.to_json(F.struct(*(c for c in df.columns if c != "site")))
    head = heads.select("site", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ordinal"), body(heads).alias("body"))
    # items have no number of their own: any order that is the same each time
    item = items.select("site", F.lit(1).alias("part"), F.xxhash64("item").alias("ordinal"), body(items).alias("body"))
    page = pages.select("site", F.lit(2).alias("part"), F.col("page_id").alias("ordinal"), body(pages).alias("body"))
    return head.unionByName(item).unionByName(page)


def write_site_reports(rows: DataFrame, path: str, stamp: str) -> None:
    """Writes ROWS as <path>/<site>-<stamp>.json, one file a site."""
    rows.sparkSession.dataSource.register(SiteReports)
    rows.repartition("site").sortWithinPartitions("site", "part", "ordinal").write.format(FORMAT).mode("append").option("stamp", stamp).save(path)


def read_site_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reports, broken): saved reports as SCHEMA has them, and file_name and text of what is none.

    A file that isn't JSON, has another shape or no site is broken; it is reported, not dropped.
    """
    df = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "*.json").json(path)
    df = df.select("*", F.col("_metadata.file_name").alias("file_name"))
    bad = F.col("broken").isNotNull() | F.col("site").isNull() | F.col("items").isNull()
    return df.where(~bad).drop("broken"), df.where(bad).select("file_name", "broken")


def saved_items(reports: DataFrame) -> DataFrame:
    """site, item, bucket, status of read reports."""
    return reports.select("site", F.explode("items").alias("i")).select("site", "i.*")


def saved_heads(reports: DataFrame) -> DataFrame:
    return reports.select("site", "report.*")
