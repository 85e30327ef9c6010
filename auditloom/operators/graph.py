"""Connected components of small clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def prepare(spark: SparkSession) -> None:
    """Sets a folder for checkpoints where the session names none, as in tests; on a cluster it must name one."""
    shared_folder(spark)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the least node reachable.

    Labels jump to the label of their label, so the rounds grow with the logarithm of a
    cluster's width; each round is checkpointed.
    """
    prepare(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    before = None
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        labels = labels.join(near, "node").select("node", F.least("component", "m").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("m"))
        labels = labels.join(far, "component", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component")).checkpoint()
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).collect()[0][0]
        if now == before:
            return labels
        before = now
