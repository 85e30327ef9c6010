"""Inputs: crawl tables, fixed example rows, reports and settings."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table out among all cores where it is read in fewer tasks than that (a small file, or one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, page_id, url, html; the site's page with the least page_id is its home page."""
    df = spread(table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")))
    return df.select(urls.site(F.col("url")).alias("site"), "page_id", "url", "html")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows, as a plan without any job."""
    names = [c.split()[0] for c in schema.split(", ")]
    literal = lambda x: "null" if x is None else str(x).lower() if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


@dataclasses.dataclass
class Settings:
    """Parameters of an audit, with their defaults."""

    max_pages: int = 50
    max_crawl: int = 50
    always: tuple[str, ...] = ("homepage", "required")
    language: str = "en"
    site_type: str | None = None


def load_settings(*paths: str) -> Settings:
    """Defaults, then each file that exists and can be read, later ones winning; JSON, or YAML where that is installed."""
    found: dict = {}
    for p in map(Path, paths):
        try:
            raw = p.read_text()
            try:
                found |= json.loads(raw)
            except ValueError:
                import yaml

                found |= yaml.safe_load(raw) or {}
        except (OSError, ImportError, TypeError):
            continue
    names = {f.name for f in dataclasses.fields(Settings)}
    return Settings(**{k: tuple(v) if k == "always" else v for k, v in found.items() if k in names})


def save_settings(settings: Settings, path: str) -> None:
    """Writes the settings as JSON; what was there before stays as a copy."""
    p = Path(path)
    if p.exists():
        p.with_suffix(p.suffix + ".bak").write_bytes(p.read_bytes())
    p.write_text(json.dumps(dataclasses.asdict(settings), indent=2))
