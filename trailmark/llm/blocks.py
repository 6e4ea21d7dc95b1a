"""Blocks: ranges of document ids, the unit in which texts are compared.

Documents are dealt into blocks of ascending ids by one shuffle, which every
later step of a plan reuses.  A block tells each shard of the hash space which
hashes it holds, once each however often they occur in it, so a passage that a
third of all documents share costs a shard one entry per block.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_small_batches

BLOCK_BYTES = 4_000_000


class Blocks(NamedTuple):
    docs: DataFrame  # block, doc_id, text, rest
    n_shards: int


def block_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: a binary search, in the JVM."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= n) & (F.get(F.lit(bounds), F.least(at + step, F.lit(n)) - 1) <= key), at + step
        ).otherwise(at),
    )


def lay_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Deal documents into blocks.

    ``carry`` columns travel in the struct ``rest``, so their names cannot
    clash with others.  Rows without an id go to negative blocks: they have no
    place in the order, remove nothing and lose nothing.  Blocks are cut at
    quantiles of the ids, each weighing its row and its bytes, so neither many short
    nor a few long documents in a row overfill one.  The bounds are one number for
    ``block_bytes`` of text; for corpora of many terabytes raise it with the
    executors' memory.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0))
    sums = docs.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = sums["b"] or 0
    n = max(-(-total // block_bytes), 2 * parts)
    picked = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.struct(F.lit(0).alias("none")).alias("rest"),
    )
    mean = max(1, total // max(1, sums["n"]))
    weighed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(0), (size / mean).cast("int"))))
    cuts = weighed.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if total else []
    bounds = sorted({int(x) for x in cuts or []})
    loose = F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    block = F.when(F.col("doc_id").isNull(), loose).otherwise(block_of(F.col("doc_id"), bounds))
    return Blocks(picked.select(block.cast("int").alias("block"), "doc_id", "text", "rest"), n)


def by_id(table: pa.Table) -> pa.Table:
    """By id, then text: the same order in every task that sees the block."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def is_loose(table: pa.Table) -> bool:
    """A block of rows without ids."""
    return table.num_rows > 0 and table["block"][0].as_py() < 0


def returned(columns: str, laid: Blocks) -> T.StructType:
    """The schema of a cut: its own columns and the carried ones."""
    return T.StructType.fromDDL(columns).add("rest", laid.docs.schema["rest"].dataType)
