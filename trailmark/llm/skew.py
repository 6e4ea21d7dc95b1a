"""A join that deals the rows of hot keys over all tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # a key with more than this part of all rows is hot, so there are fewer hot keys than this


def join_salted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], weight: str, spread: Sequence[str], total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row for each key and how many rows it has (``weight``).

    Rows of hot keys are told apart by a broadcast table of at most ``HOT`` keys (twice that, if
    ``total`` counts half of the rows), dealt by a hash of ``spread``, and meet a copy of their
    key's row in each lane.  Keys are not null.
    """
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = keyed.agg(F.sum(weight).alias("n")).first()["n"] or 0
    is_hot = F.col(weight) * HOT > F.lit(total)
    hot = keyed.filter(is_hot).select(*keys, F.lit(True).alias("_hot"))
    lane = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(lanes)).cast("int")).otherwise(0)
    marked = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_lane", lane).drop("_hot")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(keyed.withColumn("_lane", F.explode(every)), [*keys, "_lane"]).drop("_lane", weight)
