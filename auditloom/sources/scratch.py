"""Tables that a job writes and reads again: they cut the lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, in local mode alone, a folder of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditloom-"))
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, paths: list[str]) -> None:
    try:
        sc = spark.sparkContext
        for p in paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may have ended; the tables are scratch
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/scratch/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_remove, spark, _written[app])
    _written[app].append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
