"""Funnels: how far sessions or profiles get through ordered steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import where
from ..functions.timegrid import between
from ..plans.spec import EventSeries


def window_funnel(pairs: Column, steps: int, window_ms: int | None) -> Column:
    """The deepest step reached, from an array of (ts in milliseconds, step), unordered.

    Steps must follow at strictly later times, within the window from the first.
    For each step the fold keeps the latest start of a chain that reaches it and
    the time it did so; a later start never loses against an earlier one.  Of
    events of one time the deeper step comes first, so that a step reads only what
    strictly earlier events left.
    """
    turned = F.array_sort(F.transform(pairs, lambda p: F.struct(p["ts"].alias("ts"), (-p["step"]).alias("step"))))
    ordered = F.transform(turned, lambda p: F.struct(p["ts"].alias("ts"), (-p["step"]).alias("step")))
    empty = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct(F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))

    def step(state: Column, pair: Column) -> Column:
        before = F.get(state, pair["step"] - 2)
        fits = before["last"] < pair["ts"]
        if window_ms is not None:
            fits = fits & (pair["ts"] <= before["first"] + window_ms)
        reached = F.when(pair["step"] == 1, F.struct(pair["ts"].alias("first"), pair["ts"].alias("last"))).when(
            fits, F.struct(before["first"].alias("first"), pair["ts"].alias("last"))
        )
        return F.transform(state, lambda held, i: F.when((i == pair["step"] - 1) & reached.isNotNull(), reached).otherwise(held))

    final = F.aggregate(ordered, empty, step)
    return F.size(F.filter(final, lambda s: s["last"].isNotNull()))


def step_pairs(events: DataFrame, steps: Sequence[EventSeries]) -> DataFrame:
    """The events of the funnel, once for each step they match: step and ts."""
    tags = [F.when((F.col("name") == s.name) & where(s.filters), F.lit(i + 1)) for i, s in enumerate(steps)]
    named = events.filter(F.col("name").isin([s.name for s in steps]))
    return named.select("*", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("step")).withColumn("ts", F.unix_millis("created_at"))


def _levels_by_slices(pairs: DataFrame, keys: Sequence[str], steps: int, slice_ms: int) -> DataFrame:
    """How deep each key got without a time limit; ``keys``, level.

    A slice of time is told by the lowest step that a chain ending in each step can begin with there.  A key reaches a
    step in the first slice where such a chain begins with the first step, or with one whose predecessor was reached in a
    slice before.  Only one slice of a key's events is sorted by one task; a slice is one row of what follows.
    """
    rows = pairs.select(*keys, "ts", "step", F.floor(F.col("ts") / slice_ms).alias("_slice")).distinct().withColumn("_lowest", F.col("step"))
    earlier = Window.partitionBy(*keys, "_slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    for i in range(2, steps + 1):
        before = F.min(F.when(F.col("step") == i - 1, F.col("_lowest"))).over(earlier)
        rows = rows.withColumn("_lowest", F.when(F.col("step") == i, F.coalesce(before, F.lit(i))).otherwise(F.col("_lowest")))
    slices = rows.groupBy(*keys, "_slice").agg(*[F.min(F.when(F.col("step") == j, F.col("_lowest"))).alias(f"_lowest{j}") for j in range(1, steps + 1)])
    whole = Window.partitionBy(*keys)
    for j in range(1, steps + 1):
        reached = F.col(f"_lowest{j}") == 1
        for i in range(1, j):
            reached = reached | ((F.col(f"_lowest{j}") <= i + 1) & (F.col(f"_reached{i}") < F.col("_slice")))
        slices = slices.withColumn(f"_reached{j}", F.min(F.when(reached, F.col("_slice"))).over(whole))
    deepest = F.max(F.array_max(F.array(*[F.when(F.col(f"_reached{j}").isNotNull(), F.lit(j)) for j in range(1, steps + 1)])))
    return slices.groupBy(*keys).agg(deepest.alias("level")).filter("level IS NOT NULL")


def funnel_levels(
    events: DataFrame, steps: Sequence[EventSeries], start, end, window_hours: float | None = 24, group: str = "session_id", breakdowns: Sequence[str] = (), slice_hours: float = 24
) -> DataFrame:
    """project_id, who, breakdowns, level: how deep each session or profile of a project got.

    Each event carries the latest start of a chain that it ends, read from strictly
    earlier events of the step before by windows, which spill, so no key's events
    are gathered in memory.  A key is split by time: a chain that starts in a bucket
    of the window's width ends in it or in the next, so later steps stand in two
    buckets.  Without a window, slices of ``slice_hours`` are composed.
    """
    pairs = step_pairs(events.filter(between("created_at", start, end)), steps)
    keys = ["project_id", "who", *breakdowns]
    if window_hours is None:
        return _levels_by_slices(pairs.withColumn("who", F.col(group)), keys, len(steps), int(slice_hours * 3_600_000))
    window = int(window_hours * 3_600_000)
    own = F.floor(F.col("ts") / max(1, window))
    buckets = F.when(F.col("step") == 1, F.array(own)).otherwise(F.array(own - 1, own))
    rows = pairs.select("project_id", F.col(group).alias("who"), *breakdowns, "ts", "step", F.explode(buckets).alias("_bucket")).distinct()
    rows = rows.withColumn("_start", F.when(F.col("step") == 1, F.col("ts")))
    earlier = Window.partitionBy(*keys, "_bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    for i in range(2, len(steps) + 1):
        before = F.max(F.when(F.col("step") == i - 1, F.col("_start"))).over(earlier)
        fits = F.col("ts") <= before + window
        rows = rows.withColumn("_start", F.when((F.col("step") == i) & fits, before).otherwise(F.col("_start")))
    return rows.filter("_start IS NOT NULL").groupBy(*keys).agg(F.max("step").alias("level"))


def with_person(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events under the person of their session, where the session knows one."""
    persons = sessions.select("project_id", F.col("id").alias("session_id"), F.col("profile_id").alias("person"))
    return events.join(persons, ["project_id", "session_id"], "left").withColumn(
        "profile_id", F.coalesce(F.nullif("person", F.lit("")), F.col("profile_id"))
    ).drop("person")


def first_labels(events: DataFrame, steps: Sequence[EventSeries], start, end, breakdowns: Sequence[str], limit: int) -> DataFrame:
    """The breakdown values seen first in the range, ``limit`` of them: a limit on the series of a funnel or conversion."""
    named = events.filter(between("created_at", start, end) & F.col("name").isin([s.name for s in steps]))
    return named.groupBy(*breakdowns).agg(F.min("created_at").alias("_first")).orderBy("_first", *breakdowns).limit(limit).drop("_first")


def by_total(table: DataFrame, breakdowns: Sequence[str]) -> DataFrame:
    """Breakdown funnels numbered by how many entered them, most first (``place`` from 1)."""
    whole = Window.partitionBy(*breakdowns)
    entered = table.withColumn("_n", F.max(F.when(F.col("step") == 1, F.col("count"))).over(whole))
    order = Window.orderBy(F.desc("_n"), *breakdowns)  # a row for each step of each series
    return entered.withColumn("place", F.dense_rank().over(order)).drop("_n")


def funnel_steps(levels: DataFrame, n_steps: int, breakdowns: Sequence[str] = ()) -> DataFrame:
    """For each step: how many reached it, percent of the first step, drop-off, the highest one."""
    counts = levels.groupBy(*breakdowns, "level").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.select(*breakdowns).distinct() if breakdowns else counts.sparkSession.range(1).select()
    grid = groups.crossJoin(counts.sparkSession.range(1, n_steps + 1).select(F.col("id").cast("int").alias("step")))
    at = grid.join(counts.withColumnRenamed("level", "step"), [*breakdowns, "step"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy(*breakdowns).orderBy("step")
    reached = at.withColumn("count", F.sum("n").over(order.rowsBetween(0, Window.unboundedFollowing)))
    first = F.first("count").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before, after = F.lag("count").over(order), F.lead("count").over(order)
    lost = F.when(after.isNotNull(), F.col("count") - after).otherwise(0)
    out = reached.select(
        *breakdowns,
        "step",
        "count",
        F.coalesce(F.round(F.try_divide(F.col("count") * 100.0, first), 2), F.lit(0.0)).alias("percent"),
        before.alias("previous_count"),
        after.alias("next_count"),
        lost.alias("dropoff_count"),
        F.coalesce(F.round(F.try_divide(lost * 100.0, F.col("count")), 2), F.lit(0.0)).alias("dropoff_percent"),
    )
    worst = F.row_number().over(Window.partitionBy(*breakdowns).orderBy(F.desc("dropoff_percent"), "step"))
    return out.withColumn("is_highest_dropoff", (worst == 1) & (F.col("dropoff_percent") > 0))


def at_step(levels: DataFrame, step: int, dropped: bool = False) -> DataFrame:
    """Who reached a step, or stopped there."""
    return levels.filter(F.col("level") == step if dropped else F.col("level") >= step)
