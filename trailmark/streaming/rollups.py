"""Rollups kept up by a stream: each batch adds a part, a ledger says which parts count.

Parts are additive by day: counts add up, times keep the latest, distinct rows unite, sketches of
visitors merge.  A batch writes its parts first and then enters its number and their folder into the
ledger at once, so a batch that is tried again, before or after that, counts once.  Every
``compact_after`` parts are merged into one.  Readers take the parts that the ledger names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import DAILY
from ..sources.ledger import Ledger


class Rollup(NamedTuple):
    daily: Callable[[DataFrame], DataFrame]  # rows of some events, by project_id and event_date
    keys: tuple[str, ...]
    merged: dict[str, Callable[[str], Column]]  # column -> how two rows of a key become one


def daily_visitors(events: DataFrame) -> DataFrame:
    return events.groupBy("project_id", F.to_date("created_at").alias("event_date")).agg(F.hll_sketch_agg("profile_id", 12).alias("visitors"))


_DAY = ("project_id", "event_date")
ROLLUPS = {
    "users": Rollup(DAILY["users"], (*_DAY, "profile_id"), {}),
    "visitors": Rollup(daily_visitors, _DAY, {"visitors": F.hll_union_agg}),
    "event_names": Rollup(DAILY["event_names"], (*_DAY, "name"), {"last_seen": F.max, "event_count": F.sum}),
    "cohort_events": Rollup(DAILY["cohort_events"], (*_DAY, "name", "profile_id"), {"event_count": F.sum}),
    "property_values": Rollup(DAILY["property_values"], (*_DAY, "name", "property_key", "property_value"), {"last_seen": F.max, "n": F.sum}),
}


def merge(rows: DataFrame, name: str) -> DataFrame:
    """Rows of several parts as one for each key."""
    rollup = ROLLUPS[name]
    if not rollup.merged:
        return rows.select(*rollup.keys).distinct()
    return rows.groupBy(*rollup.keys).agg(*[how(c).alias(c) for c, how in rollup.merged.items()])


def _parts(spark: SparkSession, root: str, name: str, parts: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{name}/{part}" for part in parts])


def keep_rollups(root: str, names: tuple[str, ...] = tuple(ROLLUPS), compact_after: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink for ``write_batches`` that adds each batch of events to the rollups below ``root``, once."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, root)
        version, state = ledger.read()
        if batch_id <= state.get("through", -1):
            return
        part = f"batch-{batch_id}-{uuid.uuid4().hex}"
        batch = batch.persist()
        try:
            for name in names:
                ROLLUPS[name].daily(batch).write.parquet(f"{root}/{name}/{part}")
        finally:
            batch.unpersist()
        ledger.commit(version, {"through": batch_id, "parts": [*state.get("parts", []), part]})
        if len(state.get("parts", [])) + 1 >= compact_after:
            compact(spark, root, names)

    return sink


def compact(spark: SparkSession, root: str, names: tuple[str, ...] = tuple(ROLLUPS)) -> None:
    """Merges all parts into one; the old ones stay for those who read them, until ``vacuum``."""
    ledger = Ledger(spark, root)
    version, state = ledger.read()
    if len(state.get("parts", [])) < 2:
        return
    part = f"through-{state['through']}-{uuid.uuid4().hex}"
    for name in names:
        merge(_parts(spark, root, name, state["parts"]), name).write.parquet(f"{root}/{name}/{part}")
    ledger.commit(version, {**state, "parts": [part]})


def vacuum(spark: SparkSession, root: str, names: tuple[str, ...] = tuple(ROLLUPS)) -> None:
    """Deletes parts that neither the last state of the ledger nor the one before names: of failed batches, and merged ones."""
    ledger = Ledger(spark, root)
    named = {part for v in ledger.versions()[-2:] for part in ledger.read(v)[1].get("parts", [])}
    for name in names:
        for folder in ledger.folders(name, "*"):
            if folder.rsplit("/", 1)[1] not in named:
                ledger.delete(folder)


def stored_rollup(spark: SparkSession, root: str, name: str, start=None, end=None) -> DataFrame:
    """A rollup as it stands, one row for each key; days are filtered where the files are read."""
    _, state = Ledger(spark, root).read()
    if not state.get("parts"):
        raise FileNotFoundError(f"no batch has been merged below {root}")
    rows = _parts(spark, root, name, state["parts"])
    if start is not None:
        rows = rows.filter(F.col("event_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("event_date") <= F.lit(end).cast("date"))
    return merge(rows, name)
