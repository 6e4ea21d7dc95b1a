"""Time-series charts: event series, breakdowns, formulas, previous periods, tables.

All event series of a report share one scan: an event is exploded into the
indexes of the series it belongs to and aggregated by (series, labels, bucket,
profile); buckets, totals and the filling of gaps follow from that table without
another look at the events.  Buckets of a series are held in one map, whose size is
that of the calendar asked for.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import where
from ..functions.props import resolve
from ..functions.timegrid import between, bucket, buckets, previous_range
from ..plans.spec import EventSeries, FormulaSeries, ReportSpec
from .cohorts import mean_rate

PROPERTY = ("property_sum", "property_average", "property_max", "property_min")
NOT_SET = "(not set)"


def label_columns(spec: ReportSpec) -> list[str]:
    return [f"label_{i}" for i in range(len(spec.breakdowns))]


def _tagged(events: DataFrame, spec: ReportSpec) -> DataFrame:
    """The events of the report, once for each series, with bucket, labels and the number that the series measures."""
    own = [(i, s) for i, s in enumerate(spec.series) if isinstance(s, EventSeries)]
    tags = []
    for i, s in own:
        p = where(s.filters)
        tags.append(F.when(p if s.name == "*" else p & (F.col("name") == s.name), F.lit(i)))
    scoped = events.filter(between("created_at", spec.start, spec.end, spec.tz) & where(spec.filters))
    if spec.project_id:
        scoped = scoped.filter(F.col("project_id") == spec.project_id)
    if all(s.name != "*" for _, s in own):
        scoped = scoped.filter(F.col("name").isin([s.name for _, s in own]))
    named = scoped.select(
        "*",
        bucket(F.col("created_at"), spec.interval, spec.week_start, spec.tz).alias("date"),
        *[label(b).alias(f"label_{i}") for i, b in enumerate(spec.breakdowns)],
        F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("def_index"),
    )
    once = [i for i, s in own if s.segment == "one_event_per_user"]
    if once:  # the latest event of each profile in the whole range
        rank = F.row_number().over(Window.partitionBy("def_index", "project_id", "profile_id").orderBy(F.desc("created_at"), F.desc("event_id")))
        named = named.withColumn("_r", F.when(F.col("def_index").isin(once), rank).otherwise(1)).filter("_r = 1").drop("_r")
    number = F.lit(None).cast("double")
    for i, s in own:
        if s.segment in PROPERTY:
            value = F.when(F.col("revenue") > 0, F.col("revenue").cast("double")) if s.property == "revenue" else resolve(s.property).try_cast("double")
            number = F.when(F.col("def_index") == i, value).otherwise(number)
    return named.withColumn("_number", number)


def label(name: str) -> Column:
    """A breakdown's value, '(not set)' if it is empty."""
    return F.when(resolve(name) == "", NOT_SET).otherwise(resolve(name))


def _measure(spec: ReportSpec) -> Column:
    """The count of a series' bucket, from the sums of its (profile, session) rows."""
    people, sessions = F.count_distinct("project_id", "profile_id"), F.count_distinct("project_id", "session_id")
    values = {
        "event": F.sum("_n"),
        "one_event_per_user": F.sum("_n"),
        "user": people,
        "user_average": F.try_divide(F.sum("_n").cast("double"), people),
        "property_sum": F.sum("_sum"),
        "property_average": F.try_divide(F.sum("_sum"), F.sum("_known")),
        "property_max": F.max("_max"),
        "property_min": F.min("_min"),
    }
    out = F.lit(None).cast("double")
    for kind in dict.fromkeys(s.segment for s in spec.series if isinstance(s, EventSeries)):
        of_kind = [i for i, s in enumerate(spec.series) if isinstance(s, EventSeries) and s.segment == kind]
        value = sessions if kind == "session" else values[kind]
        out = F.when(F.col("def_index").isin(of_kind), F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(out)
    return out


def top_breakdowns(tagged: DataFrame, labels: Sequence[str], limit: int) -> DataFrame:
    """The label tuples with most events."""
    return tagged.groupBy(*labels).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *labels).limit(limit).select(*labels)


def semi_join_labels(rows: DataFrame, chosen: DataFrame, labels: Sequence[str]) -> DataFrame:
    named = chosen.select([F.col(c).alias(f"_{c}") for c in labels])
    return rows.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in labels]), "left_semi")


def event_chart(events: DataFrame, spec: ReportSpec, fill: bool = True) -> DataFrame:
    """def_index, labels, date, count, total_count (distinct profiles over the range)."""
    labels = label_columns(spec)
    tagged = _tagged(events, spec)
    if spec.limit is not None and labels:
        tagged = semi_join_labels(tagged, top_breakdowns(tagged, labels, spec.limit), labels)
    keys = ["def_index", *labels]
    by_session = any(isinstance(s, EventSeries) and s.segment == "session" for s in spec.series)
    each = tagged.groupBy(*keys, "date", "project_id", "profile_id", *(["session_id"] if by_session else [])).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_number").alias("_sum"),
        F.count("_number").alias("_known"),
        F.max("_number").alias("_max"),
        F.min("_number").alias("_min"),
    )
    # A row for each bucket and one for the whole range of each series.
    cols = [F.col(c) for c in keys]
    sets = each.groupingSets([[*cols, F.col("date")], cols], *cols, F.col("date")).agg(
        F.grouping("date").alias("_total"), _measure(spec).alias("count"), F.count_distinct("project_id", "profile_id").alias("_people")
    )
    entry = F.when(F.col("_total") == 0, F.struct("date", "count"))
    series = sets.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_at"), F.max(F.when(F.col("_total") == 1, F.col("_people"))).alias("total_count"))
    if not fill:
        return series.select(*keys, F.explode("_at").alias("date", "count"), "total_count")
    dates = series.select("*", F.explode(buckets(spec.start, spec.end, spec.interval, spec.week_start)).alias("date"))
    return dates.select(*keys, "date", F.coalesce(F.element_at("_at", F.col("date")), F.lit(0.0)).alias("count"), "total_count")


def formula_column(formula: str, names: Mapping[str, Column]) -> Column:
    """Arithmetic on series columns: + - * / ( ), numbers and series letters only."""

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.BinOp(left=left, op=ast.Add(), right=right):
                return walk(left) + walk(right)
            case ast.BinOp(left=left, op=ast.Sub(), right=right):
                return walk(left) - walk(right)
            case ast.BinOp(left=left, op=ast.Mult(), right=right):
                return walk(left) * walk(right)
            case ast.BinOp(left=left, op=ast.Div(), right=right):
                return F.try_divide(walk(left), walk(right))
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -walk(operand)
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
            case ast.Name(id=name) if name in names:
                return names[name]
        raise ValueError(f"not arithmetic over {', '.join(names)}: {formula}")

    return walk(ast.parse(formula, mode="eval"))


def chart(events: DataFrame, spec: ReportSpec) -> DataFrame:
    """All series of a report, formulas included, each formula beside the series it is made of."""
    labels = label_columns(spec)
    base = event_chart(events, spec)
    formulas = [(i, s) for i, s in enumerate(spec.series) if isinstance(s, FormulaSeries)]
    if not formulas:
        return base
    letters = [chr(65 + i) for i in range(len(spec.series))]
    of = lambda i, c: F.max(F.when(F.col("def_index") == i, F.col(c).cast("double")))
    wide = base.groupBy(*labels, "date").agg(*[of(i, c).alias(f"{c}_{i}") for i in range(len(spec.series)) for c in ("count", "total_count")])
    for i, s in formulas:  # later formulas may use earlier ones
        for c in ("count", "total_count"):
            known = {letters[k]: F.coalesce(f"{c}_{k}", F.lit(0.0)) for k in range(i)}
            wide = wide.withColumn(f"{c}_{i}", F.coalesce(formula_column(s.formula, known), F.lit(0.0)))
    parts = [F.struct(F.lit(i).alias("def_index"), F.col(f"count_{i}").alias("count"), F.col(f"total_count_{i}").alias("total_count")) for i in range(len(spec.series))]
    return wide.select(*labels, "date", F.explode(F.array(*parts)).alias("x")).select("x.def_index", *labels, "date", "x.count", "x.total_count").filter("count IS NOT NULL")


def chart_or_whole(events: DataFrame, spec: ReportSpec) -> DataFrame:
    """The chart; where its breakdowns match nothing, the chart without them (one action on at most one row)."""
    from dataclasses import replace

    out = chart(events, spec)
    if not spec.breakdowns or out.limit(1).count():
        return out
    whole = chart(events, replace(spec, breakdowns=(), limit=None))
    return whole.select("def_index", *[F.lit("").alias(c) for c in label_columns(spec)], "date", "count", "total_count")


def formatted(series: DataFrame, spec: ReportSpec, limit: int | None = None) -> DataFrame:
    """A row for each series, the largest sum first: id, place, names, metrics; at most ``limit`` of them.

    The id is made of the series' position and labels, so it is the same in every run.
    """
    keys = ["def_index", *label_columns(spec)]
    named = series_metrics(series, keys)
    titles = F.create_map(*[x for i, s in enumerate(spec.series) for x in (F.lit(i), F.lit(s.name if isinstance(s, EventSeries) else s.formula))])
    order = Window.orderBy(F.desc("sum"), *keys)  # a row for each series
    ranked = named.select(
        F.md5(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in keys])).alias("id"),
        F.row_number().over(order).alias("place"),
        F.element_at(titles, F.col("def_index")).alias("name"),
        "*",
    )
    return ranked.filter(F.col("place") <= limit) if limit is not None else ranked


def limit_series(series: DataFrame, spec: ReportSpec, limit: int) -> DataFrame:
    """The points of the series with the largest sums."""
    keys = ["def_index", *label_columns(spec)]
    points = [c for c in series.columns if c not in keys]
    ranked = series.groupBy(*keys).agg(F.sum("count").alias("_sum"), F.collect_list(F.struct(*points)).alias("_points"))  # a point a bucket
    return ranked.orderBy(F.desc("_sum"), *keys).limit(limit).select(*keys, F.inline("_points")).select(*series.columns)


#: The shapes of a chart; those that need no dates show one figure for each label.
SHAPES = {"linear": True, "area": True, "histogram": True, "bar": False, "pie": False, "map": False, "metric": False}


def shaped(series: DataFrame, spec: ReportSpec, shape: str) -> DataFrame:
    """The data of a chart type: points by date, or sums by label (bar, pie with shares, map) or of each series (metric)."""
    if shape not in SHAPES:
        raise ValueError(f"no such chart: {shape}")
    if SHAPES[shape]:
        return series
    keys = ["def_index", *(label_columns(spec) if shape != "metric" else [])]
    sums = series.groupBy(*keys).agg(F.sum("count").alias("count"))
    if shape != "pie":
        return sums
    share = F.try_divide(F.col("count") * 100.0, F.sum("count").over(Window.partitionBy("def_index")))
    return sums.withColumn("share", F.coalesce(F.round(share, 2), F.lit(0.0)))


def series_metrics(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sum, average (zeros left out), min and max of each series."""
    return series.groupBy(*keys).agg(
        F.sum("count").alias("sum"),
        F.coalesce(F.avg(F.when(F.col("count") != 0, F.col("count"))), F.lit(0.0)).alias("average"),
        F.min("count").alias("min"),
        F.max("count").alias("max"),
        F.max("total_count").alias("total"),
    )


def difference(current: Column, previous: Column) -> dict[str, Column]:
    """The change against a previous value: percent (2 places) and state."""
    change = F.when((previous != 0) & previous.isNotNull(), F.round((current - previous) / previous * 100, 2))
    state = F.when(current > previous, "positive").when(current < previous, "negative").otherwise("neutral")
    return {"diff": F.coalesce(F.abs(change), F.lit(0.0)), "state": state}


def with_previous(events: DataFrame, spec: ReportSpec) -> DataFrame:
    """The chart with the previous period's counts beside it, aligned by position."""
    from dataclasses import replace

    start, end = previous_range(spec.start, spec.end)
    keys = ["def_index", *label_columns(spec)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    now = chart(events, spec).withColumn("position", place)
    before = chart(events, replace(spec, start=start, end=end)).withColumn("position", place)
    both = now.join(before.select(*keys, "position", F.col("count").alias("previous")), [*keys, "position"], "left").withColumn(
        "previous", F.coalesce("previous", F.lit(0.0))
    )
    return both.select("*", *[c.alias(n) for n, c in difference(F.col("count"), F.col("previous")).items()])


def pivot_table(series: DataFrame, keys: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """A row for each series, a column for each date, with sum, average, min and max."""
    named = series.withColumn("day", F.date_format("date", "yyyyMMdd"))
    wide = named.groupBy(*keys).pivot("day", list(dates)).agg(F.first("count"))
    return wide.select(*keys, *[F.coalesce(F.col(d), F.lit(0.0)).alias(f"d{d}") for d in dates]).join(series_metrics(series, keys), list(keys))


def group_rollup(metrics: DataFrame, labels: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    """Summary rows for every prefix of the labels; with ``dates``, the sum of each of a pivot's date columns too."""
    return metrics.rollup(*labels).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("series"),
        F.sum("sum").alias("sum"),
        F.avg("average").alias("average"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        *[F.sum(f"d{d}").alias(f"d{d}") for d in dates],
    )


def breakdown_sizes(series: DataFrame, labels: Sequence[str]) -> DataFrame:
    """How many values each breakdown has, most first."""
    counts = series.agg(*[F.count_distinct(c).alias(c) for c in labels])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("values")) for c in labels])).alias("x")).select("x.*").orderBy(F.desc("values"), "label")


def drill_down(events: DataFrame, spec: ReportSpec, date, labels: dict[str, str] | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """The profiles behind one point of the first series, with what ``profiles`` (project_id, id, ...) tells of them.

    '(not set)' stands for an empty label.  Profiles that nothing is told of stay, with nulls.
    """
    s = spec.series[0]
    at = bucket(F.col("created_at"), spec.interval, spec.week_start, spec.tz) == F.lit(date).cast("timestamp")
    picked = events.filter(between("created_at", spec.start, spec.end, spec.tz) & at & where(s.filters))
    if s.name != "*":
        picked = picked.filter(F.col("name") == s.name)
    if spec.project_id:
        picked = picked.filter(F.col("project_id") == spec.project_id)
    for name, value in (labels or {}).items():
        picked = picked.filter(label(name) == value)
    counted = picked.groupBy("project_id", "profile_id").agg(F.count(F.lit(1)).alias("events"))
    if profiles is None:
        return counted
    return counted.join(profiles.withColumnRenamed("id", "profile_id"), ["project_id", "profile_id"], "left")


def project_card(events: DataFrame, as_of, month: int = 30) -> DataFrame:
    """Per project: distinct profiles of a day, a month and three months, each with those before, revenue, trend of three months.

    ``daily`` lists the profiles of each day of the last month, oldest first, 0 where there were none.
    """
    today = F.lit(as_of).cast("date")
    days = F.datediff(today, F.to_date("created_at"))
    seen = events.groupBy("project_id", days.alias("d"), "profile_id").agg(F.sum("revenue").alias("revenue"))
    people = lambda a, b: F.count_distinct(F.when((F.col("d") >= a) & (F.col("d") < b), F.col("profile_id")))
    out = seen.groupBy("project_id").agg(
        people(0, 1).alias("day"),
        people(1, 2).alias("previous_day"),
        people(0, month).alias("month"),
        people(month, 2 * month).alias("previous_month"),
        people(0, 3 * month).alias("quarter"),
        people(3 * month, 6 * month).alias("previous_quarter"),
        F.sum("revenue").alias("revenue"),
    )
    daily = seen.filter((F.col("d") >= 0) & (F.col("d") < month)).groupBy("project_id", "d").agg(F.count(F.lit(1)).alias("n"))
    filled = daily.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("_at"))
    every = F.transform(F.sequence(F.lit(month - 1), F.lit(0)), lambda d: F.coalesce(F.try_element_at("_at", d), F.lit(0)))
    change = F.try_divide((F.col("quarter") - F.col("previous_quarter")) * 100.0, F.col("previous_quarter"))
    return (
        out.join(filled, "project_id", "left")
        .withColumn("trend", F.coalesce(F.round(change, 2), F.lit(0.0)))
        .withColumn("daily", F.coalesce(every, F.array_repeat(F.lit(0).cast("long"), month)))
        .drop("_at")
    )


def references_in(references: DataFrame, spec: ReportSpec) -> DataFrame:
    """Annotations (title, date, project_id) inside a chart's range."""
    inside = between("date", spec.start, spec.end, spec.tz)
    return references.filter(inside & (F.col("project_id") == spec.project_id) if spec.project_id else inside)


def rate_table(rates: DataFrame, keys: Sequence[str], dates: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """A conversion table's rows: sums, mean rate, that of the period before (0 without), and the rate of each date."""
    named = rates.withColumn("day", F.date_format("date", "yyyyMMdd"))
    wide = named.groupBy(*keys).pivot("day", list(dates)).agg(F.first("rate"))
    sums = rates.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("conversions").alias("conversions"), mean_rate("rate").alias("mean_rate"))
    if before is not None:
        old = before.groupBy(*keys).agg(mean_rate("rate").alias("previous_mean"))
        sums = sums.join(old, list(keys), "left").withColumn("previous_mean", F.coalesce("previous_mean", F.lit(0.0)))
    return sums.join(wide.select(*keys, *[F.coalesce(F.col(d), F.lit(0.0)).alias(f"d{d}") for d in dates]), list(keys))
