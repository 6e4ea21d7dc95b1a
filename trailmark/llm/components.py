"""Connected components of a link table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import join_salted


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; a local one serves tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffles and checkpoints that nothing refers to any more.

    Spark's cleaner follows the driver's garbage collection, which may not come
    for a long time in a job of many small rounds.
    """
    spark.sparkContext._jvm.System.gc()


FEW = 1_000_000  # so many edges of one node are no burden to a task


def connected_components(nodes: DataFrame, links: DataFrame, few: int = FEW) -> DataFrame:
    """doc_id and label, the smallest doc_id reachable over links (a, b); ``nodes`` has doc_id.

    Edges are replaced, round by round, by edges to smaller neighbours (large
    star, then small star), until they form stars around the smallest node.
    Every round is cut by a checkpoint.  Neighbours are aggregated before the
    shuffle, and where a node's edges meet its smallest neighbour, those of nodes
    with very many are dealt over all tasks, so no task gets a hub's whole list.
    With at most ``few`` edges altogether a plain join does, which is easier to plan.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen, total = None, edges.count()
    while total:
        meet = (lambda rows, least: join_salted(rows, least, ["u"], "w", ["v"], total)) if total > few else (lambda rows, least: rows.join(least, "u"))  # noqa: B023
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")).select("u", F.least("u", "m").alias("m"), "w")
        # Large star: larger neighbours move to the smallest node around.
        large = meet(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours and the node itself do.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))
        moved = meet(large, low)
        small = moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = small.distinct().checkpoint()
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen, total = now, now["n"]
        release(nodes.sparkSession)
    found = edges.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.join(found, nodes["doc_id"] == found["u"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"))
