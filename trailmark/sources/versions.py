"""Tables stored by project and day, of which a ledger says what folder holds each day now.

Writing days, deleting projects and dropping old days make a new state of the ledger; folders that it
does not touch keep their files, and readers never see half of a change.  ``vacuum`` deletes files that no
recent state names.  The ledger holds an entry for each project and day of a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger


def put_days(rows: DataFrame, root: str, name: str, lying: DataFrame | None = None) -> None:
    """Stores rows with project_id and event_date; days that they hold replace what was stored of these.

    Rows of a day are brought together, but for those of ``lying``, which come from few files a day and are stored with the others
    without a shuffle.
    """
    ledger, folder = Ledger(rows.sparkSession, root), f"{name}/{uuid.uuid4().hex}"
    keyed = lambda frame: frame.withColumn("_project", F.col("project_id")).withColumn("_day", F.col("event_date"))
    placed = keyed(rows).hint("rebalance", "_project", "_day")
    placed = placed if lying is None else placed.unionByName(keyed(lying))
    placed.write.partitionBy("_project", "_day").parquet(f"{root}/{folder}")
    version, state = ledger.read()
    days = dict(state.get(name, {}))
    for path in ledger.folders(folder, "_project=*", "_day=*"):
        project, day = (unquote(x.split("=", 1)[1]) for x in path.split("/")[-2:])
        days[f"{day} {project}"] = f"{folder}/" + "/".join(path.split("/")[-2:])
    ledger.commit(version, {**state, name: days})


def get_days(spark: SparkSession, root: str, name: str, projects: Iterable[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """What is stored now; only folders of the named projects and days (ends included) are read."""
    _, state = Ledger(spark, root).read()
    kept = None if projects is None else set(projects)
    paths = []
    for entry, folder in sorted(state.get(name, {}).items()):
        day, project = entry.split(" ", 1)
        if (kept is None or project in kept) and (start is None or day >= str(start)) and (end is None or day <= str(end)):
            paths.append(f"{root}/{folder}")
    if not paths:
        if not state.get(name):
            raise FileNotFoundError(f"nothing is stored of {name} below {root}")
        return spark.read.parquet(f"{root}/{next(iter(state[name].values()))}").limit(0)
    return spark.read.parquet(*paths)


def _forget(spark: SparkSession, root: str, names: Iterable[str], gone) -> int:
    ledger = Ledger(spark, root)
    version, state = ledger.read()
    kept = {n: {e: f for e, f in days.items() if n not in names or not gone(*e.split(" ", 1))} for n, days in state.items()}
    lost = sum(map(len, state.values())) - sum(map(len, kept.values()))
    if lost:
        ledger.commit(version, kept)
    return lost


def drop_projects(spark: SparkSession, root: str, projects: Iterable[str], names: Iterable[str] | None = None) -> int:
    """Deletes projects from all tables (or the named ones) at once; the number of days that are gone."""
    gone = set(projects)
    return _forget(spark, root, set(names or Ledger(spark, root).read()[1]), lambda day, project: project in gone)


def drop_before(spark: SparkSession, root: str, name: str, first: date) -> int:
    """Deletes the days before a date."""
    return _forget(spark, root, {name}, lambda day, project: day < str(first))


def vacuum(spark: SparkSession, root: str, states: int = 2) -> int:
    """Deletes day folders that none of the last states names (readers of those may still be at work); their number."""
    ledger = Ledger(spark, root)
    recent = [ledger.read(v)[1] for v in ledger.versions()[-states:]]
    named = {folder for state in recent for days in state.values() for folder in days.values()}
    lost = 0
    for path in ledger.folders("*", "*", "_project=*", "_day=*"):
        if "/".join(path.split("/")[-4:]) not in named:
            ledger.delete(path)
            lost += 1
    return lost
