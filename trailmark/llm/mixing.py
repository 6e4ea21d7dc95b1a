"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; targets are shares of the mix by weight, stopped at
``cap`` times a source's size, the excess going to the others by weight.  A
document is emitted floor(rate) times, and once more if a draw seeded by its id
falls below the fraction of its source's rate.

The targets are closed-form: with sources ordered by cap / weight, the level
``t`` that min(weight * t, cap) must reach is the largest, over all positions,
of (budget - caps before) / (weights from here on).  That order holds one row
per source.  Documents meet their source's row by a join on source and a salt,
so a source with a third of all rows is dealt to all tasks; Spark broadcasts the
few rows instead when it finds them small at run time.

Defined cases: null texts have size 0; the null source is a source of its own,
last in order; sources of size 0 have target 0; documents with a null id draw as
if the id were the text ``null``; repeated rows draw alike; an empty table gives
an empty result; only id, text and source are read unless columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def draw(id_col: str, seed: int):
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of (source, size): source, source_size, weight, target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("double")
    ranked = (
        totals.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("level").over(Window.partitionBy())
    return (
        ranked.withColumn("level", (F.col("budget") - before) / onward)
        .withColumn("target", F.least(F.col("weight") * level, F.col("cap")))
        .select("source", "source_size", "weight", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken, rest."""
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.lit(None).cast("int").alias("rest"),
    )
    plan = targets(sized.select("source", "size"), weights, share, cap)
    dealt = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)))
    salted = plan.withColumnRenamed("source", "of").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    joined = dealt.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("lane")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor("rate") + F.when(draw("doc_id", seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", "rest")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """A row for each copy, with ``copy`` from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
