"""What each phase of a job took and gave, measured by the job itself."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored


class Phases:
    """Writes the phases of a job as tables; each one's rows are counted as they are written, without a pass of their own."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, float]] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        seen, began = Observation(name), time.monotonic()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.found.append((name, seen.get["rows"], time.monotonic() - began))
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """phase, position, n_rows, seconds, and the share of all seconds in percent."""
        total = sum(s for _, _, s in self.found) or 1.0
        rows = [(name, k, n, s, round(100 * s / total, 1)) for k, (name, n, s) in enumerate(self.found, 1)]
        return spark.createDataFrame(rows, "phase string, position long, n_rows long, seconds double, percent double")
