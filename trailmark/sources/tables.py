"""Canonical tables: events, sessions and profiles, from the raw parquet tables.

The raw ``events`` table knows only an id, a time, a user, a type, a value and a
JSON text.  The adapter derives the canonical columns from it and from ``pages``,
``nation`` and ``region`` by fixed arithmetic, so that results can be checked
against SQL.  Absent strings are '' (never null).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.urls import url_parts
from ..operators.rollups import write_days
from ..operators.sessions import session_rows, sessionize, view_duration, with_start_ids

GAP_SECONDS = 12 * 3600  # the raw events are sparse; shorter gaps leave sessions of one event


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, title, and host, origin, path, query, hash of every page's address."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")  # unused, it is not read
    return read(spark, sf_dir, "pages").select("page_id", title, *[c.alias(n) for n, c in url_parts(F.col("url")).items()])


def query_properties(query: Column) -> Column:
    """The parameters of a query string as ``__query.<name>``."""
    pairs = F.str_to_map(query, F.lit("&"), F.lit("="))
    named = F.transform_keys(pairs, lambda k, v: F.concat(F.lit("__query."), k))
    return F.map_filter(named, lambda k, v: v.isNotNull() & (v != ""))


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before sessions are known."""
    raw = read(spark, sf_dir, "events")
    parts = page_parts(spark, sf_dir)
    total = parts.agg(F.count(F.lit(1)).alias("pages"))  # one row
    place = raw.crossJoin(F.broadcast(total)).select(
        "*",
        (F.col("event_id") % F.col("pages")).alias("page_id"),
        ((F.col("event_id") * 7 + 3) % F.col("pages")).alias("referrer_id"),
        (F.col("user_id") % 25).alias("nation_id"),
    )
    referrers = parts.select(F.col("page_id").alias("referrer_id"), F.col("host").alias("referrer"))
    nations = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nation_id"), F.col("n_name").alias("country"), "n_regionkey"
    )
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    joined = (
        place.join(parts, "page_id", "left").join(referrers, "referrer_id", "left").join(nations, "nation_id", "left").join(regions, "n_regionkey", "left")
    )
    device = F.concat(F.lit("d"), F.col("user_id").cast("string"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return joined.select(
        F.col("event_id").cast("string").alias("id"),
        "event_id",
        F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("project_id"),
        device.alias("device_id"),
        F.when(F.col("user_id") % 3 == 0, device).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("profile_id"),
        text("path").alias("path"),
        text("origin").alias("origin"),
        text("title").alias("title"),
        text("referrer").alias("referrer"),
        text("country").alias("country"),
        text("region").alias("region"),
        F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long")).otherwise(F.lit(0).cast("long")).alias("revenue"),
        "value",
        F.map_concat(
            F.create_map(F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))), F.coalesce(query_properties(F.col("query")), F.create_map().cast("map<string,string>"))
        ).alias("properties"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with session ids and view durations."""
    return view_duration(sessionize(base_events(spark, sf_dir), GAP_SECONDS), "view")


def events_since(spark: SparkSession, sf_dir: str, start) -> DataFrame:
    """Canonical events from a time on, without a pass over all history: the scan begins one session gap earlier.

    They fall into the same sessions as in ``events``, as an event's session depends on its neighbours within the gap;
    the ids count from the margin, so they are only good to tell sessions of this frame apart.
    """
    margin = F.lit(start).cast("timestamp") - F.make_dt_interval(secs=F.lit(GAP_SECONDS))
    near = base_events(spark, sf_dir).filter(F.col("created_at") >= margin)
    return view_duration(sessionize(near, GAP_SECONDS), "view").filter(F.col("created_at") >= F.lit(start))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_rows(events(spark, sf_dir), "view")


def profile_history(events: DataFrame) -> DataFrame:
    """Two versions of each profile: one at its first event, one at its last."""
    seen = events.groupBy("project_id", "profile_id").agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.min("device_id").alias("device_id"), F.max("country").alias("country")
    )
    version = F.explode(F.array(F.struct(F.col("first").alias("created_at"), F.lit("old").alias("plan")), F.struct(F.col("last").alias("created_at"), F.lit("new").alias("plan"))))
    return seen.withColumn("v", version).select(
        F.col("profile_id").alias("id"),
        "project_id",
        (F.col("profile_id") != F.col("device_id")).alias("is_external"),
        F.concat(F.lit("n"), F.substring("device_id", 2, 20)).alias("first_name"),
        F.concat(F.col("profile_id"), F.lit("@example.com")).alias("email"),
        F.col("v.created_at").alias("created_at"),
        F.create_map(F.lit("plan"), F.col("v.plan"), F.lit("country"), F.col("country")).alias("properties"),
    )


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = profile_history(base_events(spark, sf_dir))
    return latest(history, ["project_id", "id"], [F.desc("created_at"), F.col("properties")["plan"]])


def materialize(spark: SparkSession, sf_dir: str, root: str, first=None, last=None) -> None:
    """Writes canonical events and sessions below ``root``, by project and day (of a session: the day it began).

    With bounds only those days are written again; begin a day before the first that changed, as a session lies in the
    folder of the day it began.  Events are read with a margin of a day on both sides for sessions that cross midnight;
    where sessions are longer than that, all days must be written.
    """
    rows = base_events(spark, sf_dir)
    if first is not None or last is not None:
        rows = rows.filter(_days("created_at", first, last, margin=1))
    # plain session numbers count from the first event that is read; these ids do not
    found = view_duration(with_start_ids(sessionize(rows, GAP_SECONDS)), "view")
    for name, table in (("events", found), ("sessions", session_rows(found, "view"))):
        write_days(table.filter(_days("created_at", first, last)).withColumn("event_date", F.to_date("created_at")), f"{root}/{name}", ["id"])


def _days(column: str, first, last, margin: int = 0) -> Column:
    kept = F.lit(True)
    if first is not None:
        kept = kept & (F.col(column) >= F.date_sub(F.lit(first).cast("date"), margin).cast("timestamp"))
    if last is not None:
        kept = kept & (F.col(column) < F.date_add(F.lit(last).cast("date"), 1 + margin).cast("timestamp"))
    return kept


def stored(spark: SparkSession, root: str, name: str, project_id: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of a table that ``materialize`` wrote; project and range (ends included) prune its folders."""
    told = spark.read.parquet(f"{root}/{name}").schema
    texts = StructType([StructField(f.name, StringType()) if f.name == "project_id" else f for f in told])  # ids of digits stay texts
    rows = spark.read.schema(texts).parquet(f"{root}/{name}")
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    if start is not None:
        rows = rows.filter((F.col("event_date") >= F.lit(start).cast("date")) & (F.col("created_at") >= F.lit(start)))
    if end is not None:
        rows = rows.filter((F.col("event_date") <= F.lit(end).cast("date")) & (F.col("created_at") <= F.lit(end)))
    return rows


def stored_by_id(spark: SparkSession, root: str, name: str, ids: Sequence[str], near=None, hours: float = 24, project_id: str | None = None) -> DataFrame:
    """Rows with one of a few ids; a time near which they lie, if it is known, leaves the folders of those days only."""
    start, end = (None, None) if near is None else (near - timedelta(hours=hours), near + timedelta(hours=hours))
    return stored(spark, root, name, project_id, start, end).filter(F.col("id").isin(*ids))


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views under the logical names, for SQL users."""
    for name, make in (("events", events), ("sessions", sessions), ("profiles", profiles)):
        make(spark, sf_dir).createOrReplaceTempView(f"canonical_{name}")
