"""Connected components and cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir, so that no executor's loss costs its lineage.

    A folder of this machine is set only in local mode, where the session names none, as in tests;
    on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is None and context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sievelight-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Large and small stars in turn: each round links neighbours to the least of them, until
    every node hangs on a root. Rounds grow with the logarithm of the longest chain. Nodes
    that are null, and loops, are left out.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = None
    around = Window.partitionBy("u")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(around), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(around))
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        was = state
