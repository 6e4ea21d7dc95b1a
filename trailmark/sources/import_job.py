"""An import as a job that goes on where it stopped.

Steps are done in order: the source's batches are staged, days are moved to production (events with session
ids and markers), session rows of the days are written, and the import is completed.  Each batch and each run of days
is entered into a ledger once its files are in place.  What was under way when a job stopped is done again and
replaces itself, so a job that was broken anywhere gives the same tables as one that was not.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imports, versions
from .ledger import Ledger

STEPS = ("loading", "moving", "backfilling_sessions", "completed")
#: Rows around midnight that are broadcast; with more, tables are shuffled.
FEW_ROWS = 100_000
#: Staged files a day beyond which events are brought together again.
FEW_FILES = 32


def status(spark: SparkSession, root: str, import_id: str) -> dict:
    """step, done (batches or days of this step), rows staged, first and last day; empty before the first run."""
    return Ledger(spark, f"{root}/imports/{import_id}").read()[1]


def run(
    spark: SparkSession,
    root: str,
    import_id: str,
    batches: dict[str, Callable[[], DataFrame]],
    days_at_once: int = 7,
    told: Callable[[dict], None] = lambda state: None,
) -> dict:
    """Does what is left of an import and returns its last state.

    ``batches`` are the parts of the source by name, mapped as by ``imports``; they may be read again by a later run, so a
    name stands for the same rows.  ``told`` hears of each state.  Events go to the table ``events_<import_id>``, session
    rows to ``sessions_<import_id>`` of ``versions``.  Sessions are told from the events of their day and its
    neighbours; one of more than two days is cut.
    """
    ledger = Ledger(spark, f"{root}/imports/{import_id}")
    version, state = ledger.read()
    state = state or {"step": STEPS[0], "done": []}
    staging = f"{root}/staging"

    def enter(**changed) -> None:
        nonlocal version, state
        ledger.commit(version, {**state, **changed})
        version, state = version + 1, {**state, **changed}
        told(state)

    if state["step"] == "loading":
        for name, read in batches.items():
            if name not in state["done"]:
                imports.stage(read(), import_id, staging, name)
                enter(done=[*state["done"], name])
        bounds = {"rows": 0, "first": None, "last": None}
        if Ledger(spark, staging).folders(f"import_id={import_id}", "*"):  # an empty source leaves nothing to read
            found = _staged(spark, staging, import_id).agg(F.count(F.lit(1)).alias("rows"), F.min("event_date").alias("first"), F.max("event_date").alias("last")).first()
            bounds = {k: v if k == "rows" else str(v) for k, v in found.asDict().items()}
        enter(step="moving", done=[], **bounds)
    for step, table, make, then in (("moving", "events", _events, "backfilling_sessions"), ("backfilling_sessions", "sessions", _sessions, "completed")):
        if state["step"] != step:
            continue
        for first, last in _runs(state, days_at_once):
            if str(first) in state["done"]:
                continue
            around = (first - timedelta(days=1), last + timedelta(days=1))
            near = _staged(spark, staging, import_id).filter(F.col("event_date").between(*around)).drop("import_id", "batch", "event_date")
            files = _files(spark, staging, import_id, *around)
            parts = [p.withColumn("event_date", F.to_date("created_at")).filter(F.col("event_date").between(first, last)) for p in make(near, files <= FEW_FILES * ((last - first).days + 3))]
            versions.put_days(parts[0], root, f"{table}_{import_id}", *parts[1:])
            enter(done=[*state["done"], str(first)])
        enter(step=then, done=[])
    return state


def _events(near: DataFrame, few_files: bool) -> list[DataFrame]:
    """What is brought together by day, and what lies so already."""
    few = imports.at_midnight(near).limit(FEW_ROWS + 1).count() <= FEW_ROWS
    base, markers = imports.production_parts(near, few_at_midnight=few)
    return [markers, base] if few_files else [base.unionByName(markers)]


def _sessions(near: DataFrame, few_files: bool) -> list[DataFrame]:
    return [imports.import_sessions(near)]


def _files(spark: SparkSession, staging: str, import_id: str, first: date, last: date) -> int:
    """How many files are staged of days."""
    found = Ledger(spark, staging).folders(f"import_id={import_id}", "*", "event_date=*", "*.parquet")
    return sum(str(first) <= path.split("/")[-2].split("=", 1)[1] <= str(last) for path in found)


def _staged(spark: SparkSession, staging: str, import_id: str) -> DataFrame:
    return spark.read.parquet(staging).filter(F.col("import_id") == import_id)


def _runs(state: dict, days: int) -> list[tuple[date, date]]:
    """The import's days in runs; a day more at both ends, where markers may fall."""
    if not state["first"]:
        return []
    at, last, out = date.fromisoformat(state["first"]) - timedelta(days=1), date.fromisoformat(state["last"]) + timedelta(days=1), []
    while at <= last:
        out.append((at, min(last, at + timedelta(days=days - 1))))
        at += timedelta(days=days)
    return out

