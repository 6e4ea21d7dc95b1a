"""Conversion, cohort retention, and how active profiles are over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import where
from ..functions.props import resolve
from ..functions.timegrid import between, bucket
from ..plans.spec import EventSeries


def conversion(
    events: DataFrame, a: EventSeries, b: EventSeries, start, end, window_hours: int, interval: str = "day", group: str = "profile_id", breakdowns: Sequence[str] = (), tz: str = "UTC"
) -> DataFrame:
    """Per bucket of A, empty breakdowns as '(not set)': A events, those followed by a B within the window, rate in percent.

    A and B go through one window per group: for each row the earliest B time in
    [t, t + window], so no A meets all B of its group.
    """
    is_a = (F.col("name") == a.name) & where(a.filters)
    is_b = (F.col("name") == b.name) & where(b.filters)
    both = events.filter(between("created_at", start, end, tz) & F.col("name").isin(a.name, b.name) & (is_a | is_b))
    t = F.unix_micros("created_at")
    order = Window.partitionBy("project_id", group).orderBy("_t").rangeBetween(0, window_hours * 3_600_000_000)
    found = both.withColumn("_t", t).withColumn("_b", F.min(F.when(is_b, F.col("_t"))).over(order))
    labels = [F.when(resolve(b) == "", "(not set)").otherwise(resolve(b)).alias(b.rsplit(".", 1)[-1]) for b in breakdowns]
    each = found.filter(is_a).groupBy("project_id", group, "created_at", *labels).agg(F.min("_b").alias("b"))
    return (
        each.groupBy(bucket(F.col("created_at"), interval, tz=tz).alias("date"), *[b.rsplit(".", 1)[-1] for b in breakdowns])
        .agg(F.count(F.lit(1)).alias("total"), F.count("b").alias("conversions"))
        .withColumn("rate", F.round(F.col("conversions") * 100.0 / F.col("total"), 2))
    )


def mean_rate(rate: str) -> Column:
    """The mean of rates of two places, to two places; halves go up, whatever order they are added in."""
    hundredths = F.sum(F.round(F.col(rate) * 100).cast("long"))
    return F.floor(hundredths / F.count(rate) + 0.5) / 100


def conversion_summary(rates: DataFrame) -> DataFrame:
    """Sums, mean rate, and the best and worst bucket of a conversion table."""
    return rates.agg(
        F.sum("total").alias("total"),
        F.sum("conversions").alias("conversions"),
        mean_rate("rate").alias("mean_rate"),
        F.date_format(F.max_by("date", F.struct(F.col("rate"), -F.unix_seconds("date"))), "yyyy-MM-dd").alias("best_date"),
        F.date_format(F.min_by("date", F.struct(F.col("rate"), F.unix_seconds("date"))), "yyyy-MM-dd").alias("worst_date"),
        F.max("rate").alias("best_rate"),
        F.min("rate").alias("worst_rate"),
    )


def series_summary(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best and the worst series by mean rate, and the mean of all of them."""
    each = rates.groupBy(*keys).agg(mean_rate("rate").alias("mean_rate"))
    label = F.concat_ws(" / ", *keys)
    return each.agg(
        F.max_by(label, F.struct("mean_rate", label)).alias("best_series"),
        F.max("mean_rate").alias("best_mean"),
        F.min_by(label, F.struct("mean_rate", label)).alias("worst_series"),
        F.min("mean_rate").alias("worst_mean"),
        mean_rate("mean_rate").alias("overall_mean"),
    )


def with_previous_rates(now: DataFrame, before: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rates beside those of the previous period, aligned by position in each series."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    old = before.withColumn("position", place).select(*keys, "position", F.col("rate").alias("previous"))
    return now.withColumn("position", place).join(old, [*keys, "position"], "left")


def cohort_events(events: DataFrame) -> DataFrame:
    """Counts per (project, name, day, profile), identified profiles only."""
    return (
        events.filter("profile_id != device_id")
        .groupBy("project_id", "name", F.to_date("created_at").alias("day"), "profile_id")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )


def cohort_matrix(daily: DataFrame, first: str, second: str, unit: str = "day", horizon: int = 7, on_or_after: bool = True) -> DataFrame:
    """cohort, size, x, users: profiles of a cohort seen x units later (or then or later)."""
    start = lambda c: F.to_date(F.date_trunc(unit, F.col(c)))
    cohorts = daily.filter(F.col("name") == first).select("project_id", "profile_id", start("day").alias("cohort")).distinct()
    later = daily.filter(F.col("name") == second).select("project_id", "profile_id", F.col("day").alias("seen")).distinct()
    months = lambda c: F.year(c) * 12 + F.month(c)
    if unit == "month":
        last, x = F.add_months("cohort", horizon), months(F.col("seen")) - months(F.col("cohort"))
    else:
        days = {"day": 1, "week": 7}[unit]
        last, x = F.date_add("cohort", horizon * days), (F.datediff(start("seen"), F.col("cohort")) / days).cast("int")
    joined = cohorts.join(later, ["project_id", "profile_id"]).filter((F.col("seen") >= F.col("cohort")) & (F.col("seen") <= last))
    if on_or_after:
        reached = joined.groupBy("cohort", "project_id", "profile_id").agg(F.max(x).alias("m"))
        hits = reached.select("cohort", "project_id", "profile_id", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("x"))
    else:
        hits = joined.select("cohort", "project_id", "profile_id", x.alias("x")).distinct()
    users = hits.groupBy("cohort", "x").agg(F.count(F.lit(1)).alias("users"))
    sizes = cohorts.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    spine = sizes.crossJoin(daily.sparkSession.range(horizon + 1).select(F.col("id").cast("int").alias("x")))
    return spine.join(users, ["cohort", "x"], "left").withColumn("users", F.coalesce("users", F.lit(0)))


def with_percentages(matrix: DataFrame) -> DataFrame:
    """The matrix with each cell as a percentage of its cohort."""
    return matrix.withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("users") * 100.0, F.col("size")), 2), F.lit(0.0)))


def weighted_average(matrix: DataFrame) -> DataFrame:
    """Mean percentage at each distance, weighted by cohort size, zeros left out."""
    rate = F.col("users") / F.col("size")
    seen = F.col("users") != 0
    return matrix.groupBy("x").agg(
        F.coalesce(F.round(F.try_divide(F.sum(F.when(seen, rate * F.col("size"))), F.sum(F.when(seen, F.col("size")))) * 100, 2), F.lit(0.0)).alias("percent")
    )


def weekly_table(events: DataFrame, periods: int = 10) -> DataFrame:
    """Week of a profile's first event × weeks until its last."""
    week = lambda c: F.to_date(F.date_trunc("week", c + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY"))
    seen = events.groupBy("project_id", "profile_id").agg(F.min("created_at").alias("f"), F.max("created_at").alias("l"))
    apart = seen.select(week(F.col("f")).alias("first_week"), (F.datediff(week(F.col("l")), week(F.col("f"))) / 7).cast("int").alias("p"))
    return apart.groupBy("first_week").agg(*[F.count_if(F.col("p") == i).alias(f"period_{i}") for i in range(periods)])


def weekly_retention(events: DataFrame) -> DataFrame:
    """Profiles active in a week, and those of them active in the next."""
    week = F.to_date(F.date_trunc("week", F.col("created_at") + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY"))
    active = events.select("project_id", "profile_id", week.alias("week")).distinct()
    following = active.select("project_id", "profile_id", F.date_sub("week", 7).alias("week"), F.lit(1).alias("again"))
    return (
        active.join(following, ["project_id", "profile_id", "week"], "left")
        .groupBy("week")
        .agg(F.count(F.lit(1)).alias("active"), F.count("again").alias("retained"))
        .withColumn("retention", F.round(F.col("retained") * 100.0 / F.col("active"), 2))
    )


def daily_profiles(events: DataFrame) -> DataFrame:
    """Distinct (project, day, profile): the exact form of the daily-active rollup."""
    return events.select("project_id", F.to_date("created_at").alias("day"), "profile_id").distinct()


def rolling_active(daily: DataFrame, days: int) -> DataFrame:
    """Distinct profiles of the last n days, each day.

    A profile's days make runs without a pause of n days; a run adds one where it begins and takes it back n days after
    its last day, so it is two rows, however long it is.
    """
    own = Window.partitionBy("project_id", "profile_id").orderBy("day")
    begins = F.coalesce(F.date_diff("day", F.lag("day").over(own)) >= days, F.lit(True))
    ends = F.coalesce(F.date_diff(F.lead("day").over(own), "day") >= days, F.lit(True))
    turns = F.array(F.when(begins, F.struct(F.col("day").alias("date"), F.lit(1).alias("n"))), F.when(ends, F.struct(F.date_add("day", days).alias("date"), F.lit(-1).alias("n"))))
    told = daily.select(turns.alias("turns")).select(F.explode(F.filter("turns", lambda t: t.isNotNull())).alias("t"))
    changes = told.groupBy("t.date").agg(F.sum("t.n").alias("n"))
    order = Window.orderBy("date")  # a row a day
    levels = changes.select("date", F.sum("n").over(order).alias("users"), F.lead("date").over(order).alias("until")).filter("users > 0")
    return levels.select(F.explode(F.sequence("date", F.date_sub("until", 1), F.expr("INTERVAL 1 DAY"))).alias("date"), "users")


def daily_sketches(events: DataFrame) -> DataFrame:
    """A mergeable sketch of each day's profiles."""
    return events.groupBy("project_id", F.to_date("created_at").alias("day")).agg(F.hll_sketch_agg("profile_id").alias("sketch"))


def rolling_active_approx(sketches: DataFrame, days: int) -> DataFrame:
    spread = sketches.withColumn("date", F.explode(F.expr(f"sequence(day, date_add(day, {days - 1}), interval 1 day)")))
    each = spread.groupBy("project_id", "date").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))
    return each.groupBy("date").agg(F.sum("users").alias("users"))  # a profile belongs to one project


def days_since_seen(events: DataFrame, as_of) -> DataFrame:
    """How many profiles were last seen n days ago."""
    last = events.groupBy("project_id", "profile_id").agg(F.max("created_at").alias("last"))
    return last.groupBy(F.datediff(F.lit(as_of).cast("date"), F.to_date("last")).alias("days")).agg(F.count(F.lit(1)).alias("users"))
