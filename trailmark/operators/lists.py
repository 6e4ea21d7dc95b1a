"""Lists of rows: pages, cursors, look-back, search catalogues."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import between


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page (from 0); the order must end in a unique column."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_with_total(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page with ``total``, the number of all rows, and ``pages``; one row of counts is broadcast."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return page(rows, order, number, size).crossJoin(F.broadcast(total))


def with_details(rows: DataFrame, details: DataFrame, keys: Sequence[str], wanted: bool) -> DataFrame:
    """Rows with the columns of ``details`` (one row for each key), if they are asked for."""
    return rows.join(details, list(keys), "left") if wanted else rows


def encode_cursor(at: datetime, row_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([at.isoformat(), row_id]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    at, row_id = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return datetime.fromisoformat(at), row_id


def keyset_page(rows: DataFrame, cursor: str | None, size: int) -> DataFrame:
    """The newest rows after a cursor, by (created_at, id)."""
    if cursor:
        at, row_id = decode_cursor(cursor)
        t = F.lit(at).cast("timestamp")
        rows = rows.filter((F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("id") < row_id)))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def look_back(rows: DataFrame, until: datetime, size: int, first_days: float = 0.5, most_days: float = 365) -> DataFrame:
    """The newest rows up to a time, from the shortest of doubling ranges that holds any."""
    days = first_days
    while True:
        found = rows.filter(between("created_at", until - timedelta(days=days), until))
        if days >= most_days or found.limit(1).count():
            return found.orderBy(F.desc("created_at"), F.desc("id")).limit(size)
        days *= 2


def property_catalogue(events: DataFrame) -> DataFrame:
    """Property keys by recency; positions in lists are folded."""
    keys = events.select(F.explode(F.map_keys("properties")).alias("key"), "created_at")
    folded = F.regexp_replace(F.regexp_replace("key", r"\.\d+\.", ".*."), r"\.\d+$", "[*]")
    return keys.groupBy(F.concat(F.lit("properties."), folded).alias("property")).agg(F.max("created_at").alias("last_seen"))


def full_catalogue(events: DataFrame, profiles: DataFrame, fixed: Sequence[str]) -> DataFrame:
    """Event properties, profile properties and the fixed columns, shortest names first; last_seen is null for the latter two."""
    none = F.lit(None).cast("timestamp").alias("last_seen")
    of_profiles = profiles.select(F.explode(F.map_keys("properties")).alias("k")).distinct().select(F.concat(F.lit("profile.properties."), "k").alias("property"), none)
    columns = events.sparkSession.createDataFrame([(c,) for c in [*fixed, "has_profile"]], "property string").select("property", none)
    return property_catalogue(events).unionByName(of_profiles).unionByName(columns).orderBy(F.length("property"), "property")


def column_values(events: DataFrame, column: str, as_of: datetime, months: int = 6, most: int = 100_000) -> DataFrame:
    """Distinct values of a plain column over the last months, shortest first; ``has_profile`` is yes or no."""
    if column == "has_profile":
        return events.sparkSession.createDataFrame([("true",), ("false",)], "value string")
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    recent = events.filter((F.col("created_at") >= since) & (F.col("created_at") <= F.lit(as_of)))
    values = recent.select(F.col(column).cast("string").alias("value")).filter("value <> ''").distinct()
    return values.orderBy(F.length("value"), "value").limit(most)


def property_values(events: DataFrame) -> DataFrame:
    """Values of every event property with their number and last time; empty ones and internal keys left out."""
    pairs = events.select("project_id", "name", "created_at", F.explode("properties").alias("property_key", "property_value"))
    return (
        pairs.filter((F.col("property_value") != "") & ~F.col("property_key").isin("__duration", "__duration_from"))
        .groupBy("project_id", "name", "property_key", "property_value")
        .agg(F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    )


def device_closure(events: DataFrame, profile_id: str) -> DataFrame:
    """Events of a profile and of every device it ever used, in each project by itself."""
    used = events.filter((F.col("profile_id") == profile_id) & (F.col("device_id") != "")).select("project_id", "device_id").distinct()
    of_device = events.join(used, ["project_id", "device_id"], "left_semi").filter(~F.col("profile_id").eqNullSafe(profile_id))
    return of_device.unionByName(events.filter(F.col("profile_id") == profile_id).select(of_device.columns))


def apply_hook(rows: DataFrame, hook: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """A caller's own step in the middle of a list."""
    return hook(rows) if hook else rows
