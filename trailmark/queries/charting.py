"""Charts, funnels, conversion, cohorts, retention."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.timegrid import between, bucket, named_range, previous_range
from ..operators import charts as C
from ..operators import cohorts as K
from ..operators import funnel as Fn
from ..plans.spec import EventSeries, FormulaSeries, ReportSpec
from ..sources import tables as T
from .base import AS_OF, END, START, day, query, text

IN = "created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"
DAYS = "(SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) AS date)"


def _spec(*series, **more):
    return ReportSpec(series=series, start=START, end=END, **more)


def _out(chart, labels=0):
    return chart.select("def_index", *[f"label_{i}" for i in range(labels)], day("date").alias("date"), "count", F.col("total_count").cast("long").alias("total_count"))


def _daily(measure, names, keys="", total="count(DISTINCT profile_id)"):
    """Series by name and day, gaps filled."""
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    match = "(d.name = '*' OR d.name = ev.name)"
    return f"""WITH defs(def_index, name) AS (VALUES {listed}),
    tagged AS (SELECT d.def_index, ev.*, date_trunc('day', created_at) AS date FROM ev JOIN defs d ON {match} WHERE {IN}),
    totals AS (SELECT def_index, {total} AS total_count FROM tagged GROUP BY def_index),
    counted AS (SELECT def_index, date, CAST({measure} AS DOUBLE) AS count FROM tagged GROUP BY def_index, date)
    SELECT t.def_index, strftime(g.date, '%Y-%m-%d') AS date, coalesce(c.count, 0) AS count, total_count
    FROM totals t CROSS JOIN {DAYS} g LEFT JOIN counted c ON c.def_index = t.def_index AND CAST(c.date AS TIMESTAMP) = g.date"""


@query(_daily("count(DISTINCT profile_id)", ["view", "click", "purchase", "signup", "error"]))
def chart_users_daily(spark, sf_dir):
    """The flagship: daily users by event type, gap-filled, with totals."""
    return _out(C.chart(T.base_events(spark, sf_dir), _spec(*[EventSeries(n, "user") for n in ("view", "click", "purchase", "signup", "error")])))


@query(_daily("count(*)", ["view", "purchase"]))
def chart_events_daily(spark, sf_dir):
    return _out(C.chart(T.base_events(spark, sf_dir), _spec(EventSeries("view"), EventSeries("purchase"))))


@query(_daily("count(*)", ["*"]))
def chart_any_event(spark, sf_dir):
    return _out(C.chart(T.base_events(spark, sf_dir), _spec(EventSeries("*"))))


@query(_daily("count(*) * 1.0 / count(DISTINCT profile_id)", ["click"]))
def chart_user_average(spark, sf_dir):
    return _out(C.chart(T.base_events(spark, sf_dir), _spec(EventSeries("click", "user_average"))))


@query(
    f"""WITH h AS (SELECT date_trunc('hour', created_at) AS date, count(DISTINCT profile_id) AS count FROM ev WHERE name = 'view' AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' GROUP BY 1),
    t AS (SELECT count(DISTINCT profile_id) AS total_count FROM ev WHERE name = 'view' AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07')
    SELECT strftime(g.date, '%Y-%m-%d %H:%M:%S') AS date, CAST(coalesce(count, 0) AS DOUBLE) AS count, total_count
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06 23:00:00', INTERVAL 1 HOUR)) AS date) g CROSS JOIN t LEFT JOIN h ON h.date = g.date"""
)
def chart_users_hourly(spark, sf_dir):
    spec = replace(_spec(EventSeries("view", "user"), interval="hour"), end=datetime(2024, 1, 7))
    return C.chart(T.base_events(spark, sf_dir), spec).select(text("date").alias("date"), "count", "total_count")


@query(
    f"""WITH w AS (SELECT date_trunc('week', created_at + INTERVAL 1 DAY) - INTERVAL 1 DAY AS date, count(DISTINCT session_id) AS count FROM ev WHERE name = 'view' AND {IN} GROUP BY 1)
    SELECT strftime(g.date, '%Y-%m-%d') AS date, CAST(coalesce(count, 0) AS DOUBLE) AS count
    FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-24', INTERVAL 7 DAY)) AS date) g LEFT JOIN w ON w.date = g.date"""
)
def chart_sessions_weekly(spark, sf_dir):
    spec = _spec(EventSeries("view", "session"), interval="week", week_start="sunday")
    return C.chart(T.events(spark, sf_dir), spec).select(day("date").alias("date"), "count")


@query(
    f"""WITH c AS (SELECT date_trunc('day', created_at) AS date, sum(try_cast(k AS DOUBLE)) AS s, avg(try_cast(k AS DOUBLE)) AS a, max(try_cast(k AS DOUBLE)) AS mx, min(try_cast(k AS DOUBLE)) AS mn,
    sum(CASE WHEN revenue > 0 THEN revenue END) AS r FROM ev WHERE name = 'purchase' AND {IN} GROUP BY 1)
    SELECT i AS def_index, strftime(g.date, '%Y-%m-%d') AS date, coalesce(CAST([s, a, mx, mn, r][i + 1] AS DOUBLE), 0) AS count
    FROM {DAYS} g CROSS JOIN (SELECT unnest(range(5))::INTEGER AS i) LEFT JOIN c ON CAST(c.date AS TIMESTAMP) = g.date"""
)
def chart_property_agg(spark, sf_dir):
    kinds = ["property_sum", "property_average", "property_max", "property_min"]
    series = [EventSeries("purchase", k, "properties.k") for k in kinds] + [EventSeries("purchase", "property_sum", "revenue")]
    return C.chart(T.base_events(spark, sf_dir), _spec(*series)).select("def_index", day("date").alias("date"), "count")


@query(
    f"""WITH last AS (SELECT * FROM ev WHERE name = 'view' AND {IN} QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, event_id DESC) = 1),
    c AS (SELECT date_trunc('day', created_at) AS date, count(*) AS n FROM last GROUP BY 1)
    SELECT strftime(g.date, '%Y-%m-%d') AS date, CAST(coalesce(n, 0) AS DOUBLE) AS count FROM {DAYS} g LEFT JOIN c ON CAST(c.date AS TIMESTAMP) = g.date"""
)
def chart_one_event_per_user(spark, sf_dir):
    return C.chart(T.base_events(spark, sf_dir), _spec(EventSeries("view", "one_event_per_user"))).select(day("date").alias("date"), "count")


_BROKEN = f"""WITH tagged AS (SELECT *, date_trunc('day', created_at) AS date, CASE WHEN utm_source = '' THEN '(not set)' ELSE utm_source END AS label_1 FROM ev WHERE name = 'view' AND {IN}),
    totals AS (SELECT region AS label_0, label_1, count(DISTINCT profile_id) AS total_count FROM tagged GROUP BY ALL),
    counted AS (SELECT region AS label_0, label_1, date, count(*) AS n FROM tagged GROUP BY ALL)
    SELECT 0 AS def_index, t.label_0, t.label_1, strftime(g.date, '%Y-%m-%d') AS date, CAST(coalesce(n, 0) AS DOUBLE) AS count, total_count
    FROM totals t CROSS JOIN {DAYS} g LEFT JOIN counted c ON c.label_0 = t.label_0 AND c.label_1 = t.label_1 AND CAST(c.date AS TIMESTAMP) = g.date"""


@query(_BROKEN)
def chart_breakdown(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("region", "properties.__query.utm_source"))
    return _out(C.chart(T.base_events(spark, sf_dir), spec), 2)


@query(
    f"""WITH tagged AS (SELECT *, date_trunc('day', created_at) AS date FROM ev WHERE name = 'view' AND {IN}),
    top AS (SELECT country FROM tagged GROUP BY country ORDER BY count(*) DESC, country LIMIT 3),
    counted AS (SELECT country, date, count(*) AS n FROM tagged JOIN top USING (country) GROUP BY ALL),
    totals AS (SELECT country, count(DISTINCT profile_id) AS total_count FROM tagged JOIN top USING (country) GROUP BY ALL)
    SELECT 0 AS def_index, t.country AS label_0, strftime(g.date, '%Y-%m-%d') AS date, CAST(coalesce(n, 0) AS DOUBLE) AS count, total_count
    FROM totals t CROSS JOIN {DAYS} g LEFT JOIN counted c ON c.country = t.country AND CAST(c.date AS TIMESTAMP) = g.date"""
)
def chart_top_breakdowns(spark, sf_dir):
    return _out(C.chart(T.base_events(spark, sf_dir), _spec(EventSeries("view"), breakdowns=("country",), limit=3)), 1)


@query(f"SELECT region AS label_0, count(DISTINCT profile_id) AS total_count, CAST(count(*) AS DOUBLE) AS count FROM ev WHERE name = 'signup' AND {IN} GROUP BY region")
def chart_total_count(spark, sf_dir):
    series = C.chart(T.base_events(spark, sf_dir), _spec(EventSeries("signup"), breakdowns=("region",)))
    return series.groupBy("label_0").agg(F.max("total_count").alias("total_count"), F.sum("count").alias("count"))


@query(
    f"""WITH c AS (SELECT region, date_trunc('day', created_at) AS date, count(*) FILTER (name = 'purchase') AS a, count(*) FILTER (name = 'view') AS b FROM ev WHERE name IN ('purchase', 'view') AND {IN} GROUP BY ALL),
    g AS (SELECT region, date FROM (SELECT DISTINCT region FROM c) CROSS JOIN {DAYS}),
    t AS (SELECT region, count(DISTINCT profile_id) FILTER (name = 'purchase')::DOUBLE AS ta, count(DISTINCT profile_id) FILTER (name = 'view')::DOUBLE AS tb FROM ev WHERE name IN ('purchase', 'view') AND {IN} GROUP BY region),
    f AS (SELECT g.region, g.date, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b FROM g LEFT JOIN c ON c.region = g.region AND CAST(c.date AS TIMESTAMP) = g.date)
    SELECT region AS label_0, strftime(date, '%Y-%m-%d') AS date, CASE WHEN b = 0 THEN 0 ELSE a / b * 100 END AS ratio,
    (CASE WHEN b = 0 THEN 0 ELSE a / b * 100 END) + 1 AS shifted, CASE WHEN tb = 0 THEN 0 ELSE ta / tb * 100 END AS total_ratio FROM f JOIN t USING (region)"""
)
def chart_formula(spark, sf_dir):
    spec = _spec(EventSeries("purchase"), EventSeries("view"), FormulaSeries("A / B * 100"), FormulaSeries("C + 1"), breakdowns=("region",))
    rows = C.chart(T.base_events(spark, sf_dir), spec)
    pick = lambda i: F.max(F.when(F.col("def_index") == i, F.col("count")))
    total = F.max(F.when(F.col("def_index") == 2, F.col("total_count")))
    return rows.groupBy("label_0", day("date").alias("date")).agg(pick(2).alias("ratio"), pick(3).alias("shifted"), total.alias("total_ratio"))


@query(
    """WITH c AS (SELECT date_trunc('day', created_at) AS date, count(*)::DOUBLE AS n FROM ev WHERE name = 'view' GROUP BY 1),
    now AS (SELECT g.date, coalesce(n, 0) AS n, row_number() OVER (ORDER BY g.date) AS p FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-22', INTERVAL 1 DAY)) AS date) g LEFT JOIN c ON CAST(c.date AS TIMESTAMP) = g.date),
    old AS (SELECT g.date, coalesce(n, 0) AS n, row_number() OVER (ORDER BY g.date) AS p FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-15', INTERVAL 1 DAY)) AS date) g LEFT JOIN c ON CAST(c.date AS TIMESTAMP) = g.date)
    SELECT strftime(now.date, '%Y-%m-%d') AS date, now.n AS count, old.n AS previous,
    CASE WHEN old.n = 0 THEN 0 ELSE abs(round((now.n - old.n) / old.n * 100, 2)) END AS diff,
    CASE WHEN now.n > old.n THEN 'positive' WHEN now.n < old.n THEN 'negative' ELSE 'neutral' END AS state FROM now JOIN old USING (p)"""
)
def chart_previous(spark, sf_dir):
    spec = ReportSpec((EventSeries("view"),), datetime(2024, 1, 16), datetime(2024, 1, 22, 23, 59, 59, 999000))
    return C.with_previous(T.base_events(spark, sf_dir), spec).select(day("date").alias("date"), "count", "previous", "diff", "state")


@query(f"WITH s AS ({_BROKEN.replace('WITH tagged', 'WITH tagged', 1)}) SELECT 1".replace("SELECT 1", "SELECT label_0, label_1, sum(count) AS sum, coalesce(avg(CASE WHEN count <> 0 THEN count END), 0) AS average, min(count) AS min, max(count) AS max, max(total_count) AS total FROM s GROUP BY ALL"))
def chart_metrics(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("region", "properties.__query.utm_source"))
    return C.series_metrics(C.chart(T.base_events(spark, sf_dir), spec), ["label_0", "label_1"])


@query(f"WITH s AS ({_BROKEN}) SELECT label_0, label_1, sum(count) FILTER (date = '2024-01-05') AS d20240105, sum(count) FILTER (date = '2024-01-06') AS d20240106, sum(count) AS sum, coalesce(avg(CASE WHEN count <> 0 THEN count END), 0) AS average, min(count) AS min, max(count) AS max FROM s GROUP BY ALL")
def chart_pivot(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("region", "properties.__query.utm_source"))
    wide = C.pivot_table(C.chart(T.base_events(spark, sf_dir), spec), ["label_0", "label_1"], ["20240105", "20240106"])
    return wide.select("label_0", "label_1", "d20240105", "d20240106", "sum", "average", "min", "max")


@query(
    f"WITH s AS ({_BROKEN}), m AS (SELECT label_0, label_1, sum(count) AS sum, coalesce(avg(CASE WHEN count <> 0 THEN count END), 0) AS av, min(count) AS mn, max(count) AS mx, sum(count) FILTER (date = '2024-01-06') AS d FROM s GROUP BY label_0, label_1) "
    "SELECT label_0, label_1, CAST(grouping(label_0, label_1) AS BIGINT) AS level, count(*) AS series, sum(sum) AS sum, round(avg(av), 6) AS average, min(mn) AS min, max(mx) AS max, sum(d) AS d20240106 FROM m GROUP BY ROLLUP (label_0, label_1)"
)
def chart_group_rollup(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("region", "properties.__query.utm_source"))
    wide = C.pivot_table(C.chart(T.base_events(spark, sf_dir), spec), ["label_0", "label_1"], ["20240106"])
    rolled = C.group_rollup(wide, ["label_0", "label_1"], ["20240106"])
    return rolled.withColumn("level", F.col("level").cast("long")).withColumn("average", F.round("average", 6))


@query(f"WITH s AS ({_BROKEN}) SELECT 'label_0' AS label, count(DISTINCT label_0) AS values FROM s UNION ALL SELECT 'label_1', count(DISTINCT label_1) FROM s")
def chart_breakdown_order(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("region", "properties.__query.utm_source"))
    return C.breakdown_sizes(C.chart(T.base_events(spark, sf_dir), spec), ["label_0", "label_1"])


@query("SELECT d.project_id, profile_id, events, first_name, email, is_external FROM (SELECT project_id, profile_id, count(*) AS events FROM ev WHERE name = 'view' AND region = 'ASIA' AND date_trunc('day', created_at) = TIMESTAMP '2024-01-10' GROUP BY ALL) d LEFT JOIN pr ON pr.id = profile_id AND pr.project_id = d.project_id")
def chart_drilldown_profiles(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("region",))
    people = T.profiles(spark, sf_dir).select("project_id", "id", "first_name", "email", "is_external")
    return C.drill_down(T.base_events(spark, sf_dir), spec, datetime(2024, 1, 10), {"region": "ASIA"}, people)


@query(
    """WITH d AS (SELECT *, date_diff('day', CAST(created_at AS DATE), DATE '2024-01-28') AS n FROM ev),
    c AS (SELECT project_id, count(DISTINCT profile_id) FILTER (n = 0) AS day, count(DISTINCT profile_id) FILTER (n = 1) AS previous_day, count(DISTINCT profile_id) FILTER (n >= 0 AND n < 7) AS month,
    count(DISTINCT profile_id) FILTER (n >= 7 AND n < 14) AS previous_month, count(DISTINCT profile_id) FILTER (n >= 0 AND n < 21) AS quarter, count(DISTINCT profile_id) FILTER (n >= 21 AND n < 42) AS previous_quarter,
    CAST(sum(revenue) AS BIGINT) AS revenue FROM d GROUP BY project_id),
    l AS (SELECT project_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY x DESC) AS daily FROM (SELECT c.project_id, x, (SELECT count(DISTINCT profile_id) FROM d WHERE d.project_id = c.project_id AND n = x) AS m FROM c CROSS JOIN (SELECT unnest(range(7)) AS x)) GROUP BY project_id)
    SELECT c.*, CASE WHEN previous_quarter = 0 THEN 0 ELSE round((quarter - previous_quarter) * 100.0::DOUBLE / previous_quarter, 2) END AS trend, daily FROM c JOIN l USING (project_id)"""
)
def project_card(spark, sf_dir):
    return C.project_card(T.base_events(spark, sf_dir), AS_OF, 7).withColumn("daily", F.array_join("daily", ","))  # a month of seven days: the table holds four weeks


STEPS = [EventSeries("view"), EventSeries("click"), EventSeries("purchase")]


def _levels(who, source="ev", more=""):
    cols = f"{who} AS who{more}"
    on = "USING (who{})".format("".join("," + c for c in [x.strip() for x in more.split(",") if x.strip()]))
    group = ", ".join(["who", *[x.strip() for x in more.split(",") if x.strip()]])
    return f"""f1 AS (SELECT {cols}, epoch_ms(created_at) AS t FROM {source} WHERE name = 'view' AND {IN}),
    f2 AS (SELECT {cols}, epoch_ms(created_at) AS t FROM {source} WHERE name = 'click' AND {IN}),
    f3 AS (SELECT {cols}, epoch_ms(created_at) AS t FROM {source} WHERE name = 'purchase' AND {IN}),
    c2 AS (SELECT {group}, f1.t AS t1, f2.t AS t2 FROM f1 JOIN f2 {on} WHERE f1.t < f2.t AND f2.t <= f1.t + 86400000),
    c3 AS (SELECT DISTINCT {group} FROM c2 JOIN f3 {on} WHERE f3.t > c2.t2 AND f3.t <= c2.t1 + 86400000),
    levels AS (SELECT {group}, max(level) AS level FROM (SELECT {group}, 1 AS level FROM f1 UNION ALL SELECT {group}, 2 FROM c2 UNION ALL SELECT {group}, 3 FROM c3) GROUP BY {group})"""


def _funnel(spark, sf_dir, group, events=None, **more):
    return Fn.funnel_levels(events if events is not None else T.events(spark, sf_dir), STEPS, START, END, 24, group, **more)


@query("WITH " + _levels("session_id") + " SELECT who, level FROM levels")
def funnel_session(spark, sf_dir):
    return _funnel(spark, sf_dir, "session_id").select("who", "level")


@query("WITH person AS (SELECT ev.* EXCLUDE (profile_id), coalesce(nullif(ss.profile_id, ''), ev.profile_id) AS profile_id FROM ev LEFT JOIN ss ON ss.id = ev.session_id), " + _levels("profile_id", "person") + " SELECT who, level FROM levels")
def funnel_profile(spark, sf_dir):
    return _funnel(spark, sf_dir, "profile_id", Fn.with_person(T.events(spark, sf_dir), T.sessions(spark, sf_dir))).select("who", "level")


@query(
    f"""WITH e AS (SELECT project_id, profile_id AS who, name, created_at AS t FROM ev WHERE name IN ('view', 'click', 'purchase') AND {IN}),
    a AS (SELECT project_id, who, min(t) AS t FROM e WHERE name = '{STEPS[0].name}' GROUP BY ALL),
    b AS (SELECT project_id, who, min(e.t) AS t FROM e JOIN a USING (project_id, who) WHERE name = '{STEPS[1].name}' AND e.t > a.t GROUP BY ALL),
    c AS (SELECT project_id, who, min(e.t) AS t FROM e JOIN b USING (project_id, who) WHERE name = '{STEPS[2].name}' AND e.t > b.t GROUP BY ALL)
    SELECT who, max(level) AS level FROM (SELECT project_id, who, 1 AS level FROM a UNION ALL SELECT project_id, who, 2 FROM b UNION ALL SELECT project_id, who, 3 FROM c) GROUP BY project_id, who"""
)
def funnel_no_window(spark, sf_dir):
    """A funnel of profiles without a time limit, composed from six-hour slices."""
    return Fn.funnel_levels(T.events(spark, sf_dir), STEPS, START, END, None, "profile_id", slice_hours=6).select("who", "level")


_STEPS_SQL = """, grid AS (SELECT {g} step FROM {from_} CROSS JOIN (SELECT unnest([1, 2, 3]) AS step)),
    counted AS (SELECT grid.*, (SELECT count(*) FROM levels l WHERE l.level >= grid.step {same}) AS count FROM grid),
    around AS (SELECT *, first_value(count) OVER w AS f, lag(count) OVER w AS p, lead(count) OVER w AS n FROM counted WINDOW w AS ({part} ORDER BY step)),
    dropped AS (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE count - n END AS d FROM around),
    rated AS (SELECT *, CASE WHEN f = 0 THEN 0 ELSE round(count * 100.0::DOUBLE / f, 2) END AS percent, CASE WHEN count = 0 THEN 0 ELSE round(d * 100.0::DOUBLE / count, 2) END AS dp FROM dropped)
    SELECT {g} step, count, percent, p AS previous_count, n AS next_count, d AS dropoff_count, dp AS dropoff_percent,
    dp > 0 AND row_number() OVER ({part} ORDER BY dp DESC, step) = 1 AS is_highest_dropoff FROM rated"""


@query("WITH " + _levels("profile_id") + _STEPS_SQL.format(g="", from_="(SELECT 1)", same="", part=""))
def funnel_steps(spark, sf_dir):
    return Fn.funnel_steps(_funnel(spark, sf_dir, "profile_id", T.base_events(spark, sf_dir)), 3)


@query(
    "WITH " + _levels("profile_id", more=", region")
    + _STEPS_SQL.format(g="region,", from_="(SELECT DISTINCT region FROM levels)", same="AND l.region = grid.region", part="PARTITION BY region")
)
def funnel_breakdown(spark, sf_dir):
    return Fn.funnel_steps(_funnel(spark, sf_dir, "profile_id", T.base_events(spark, sf_dir), breakdowns=["region"]), 3, ["region"])


@query("WITH " + _levels("profile_id") + " SELECT who AS profile_id, first_name FROM levels LEFT JOIN pr ON pr.id = who WHERE level = 2")
def funnel_dropoff_profiles(spark, sf_dir):
    stopped = Fn.at_step(_funnel(spark, sf_dir, "profile_id", T.base_events(spark, sf_dir)), 2, dropped=True)
    return stopped.join(T.profiles(spark, sf_dir).select("project_id", F.col("id").alias("who"), "first_name"), ["project_id", "who"], "left").select(F.col("who").alias("profile_id"), "first_name")


def _shift(sql):
    return sql.replace("TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'", "TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-04 23:59:59'")


def _renamed(sql, suffix):
    return re.sub(r"\b(f[123]|c[23]|levels)\b", rf"\1{suffix}", sql)


@query(
    "WITH " + _levels("session_id") + ", " + _renamed(_shift(_levels("session_id")) + " ", "b")
    + " SELECT s AS step, (SELECT count(*) FROM levels WHERE level >= s) AS current, (SELECT count(*) FROM levelsb WHERE level >= s) AS previous FROM (SELECT unnest([1, 2, 3]) AS s)"
)
def funnel_previous(spark, sf_dir):
    events = T.events(spark, sf_dir)
    now = Fn.funnel_steps(Fn.funnel_levels(events, STEPS, START, END, 24), 3)
    old = Fn.funnel_steps(Fn.funnel_levels(events, STEPS, datetime(2024, 1, 1), datetime(2024, 1, 4, 23, 59, 59), 24), 3)
    return now.select("step", F.col("count").alias("current")).join(old.select("step", F.col("count").alias("previous")), "step")


def _conv(keys=""):
    comma = ", " + keys if keys else ""
    return f"""conv AS (SELECT profile_id, a.created_at, date_trunc('day', a.created_at) AS date{comma},
    (SELECT min(b.created_at) FROM ev b WHERE b.profile_id = a.profile_id AND b.name = 'purchase' AND b.{IN} AND b.created_at BETWEEN a.created_at AND a.created_at + INTERVAL 24 HOUR) AS b
    FROM ev a WHERE name = 'view' AND a.{IN}),
    rates AS (SELECT date{comma}, count(*) AS total, count(b) AS conversions, round(count(b) * 100.0::DOUBLE / count(*), 2) AS rate FROM conv GROUP BY ALL)"""


def _rates(spark, sf_dir, **more):
    return K.conversion(T.base_events(spark, sf_dir), EventSeries("view"), EventSeries("purchase"), START, END, 24, **more)


@query("WITH " + _conv() + " SELECT strftime(date, '%Y-%m-%d') AS date, total, conversions, rate FROM rates")
def conversion_daily(spark, sf_dir):
    return _rates(spark, sf_dir).withColumn("date", day("date"))


@query("WITH " + _conv("region") + " SELECT strftime(date, '%Y-%m-%d') AS date, region, total, conversions, rate FROM rates")
def conversion_breakdown(spark, sf_dir):
    return _rates(spark, sf_dir, breakdowns=["region"]).withColumn("date", day("date"))


@query(
    "WITH " + _conv() + """ SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(conversions) AS BIGINT) AS conversions, floor(sum(CAST(round(rate * 100) AS BIGINT)) / count(*) + 0.5) / 100 AS mean_rate,
    (SELECT strftime(date, '%Y-%m-%d') FROM rates ORDER BY rate DESC, date LIMIT 1) AS best_date, (SELECT strftime(date, '%Y-%m-%d') FROM rates ORDER BY rate, date LIMIT 1) AS worst_date,
    max(rate) AS best_rate, min(rate) AS worst_rate FROM rates"""
)
def conversion_summary(spark, sf_dir):
    return K.conversion_summary(_rates(spark, sf_dir))


@query(
    "WITH " + _conv("region") + """ SELECT region, CAST(sum(total) AS BIGINT) AS total, CAST(sum(conversions) AS BIGINT) AS conversions, floor(sum(CAST(round(rate * 100) AS BIGINT)) / count(*) + 0.5) / 100 AS mean_rate,
    coalesce(max(rate) FILTER (strftime(date, '%Y%m%d') = '20240105'), 0) AS d20240105, coalesce(max(rate) FILTER (strftime(date, '%Y%m%d') = '20240106'), 0) AS d20240106 FROM rates GROUP BY region"""
)
def conversion_table(spark, sf_dir):
    return C.rate_table(_rates(spark, sf_dir, breakdowns=["region"]), ["region"], ["20240105", "20240106"])


_HALF = "created_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-24 23:59:59.999'"
_BEFORE = "created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-14 23:59:59.999'"


def _two_periods(keys=""):
    now, old = (re.sub(r"\b(conv|rates)\b", rf"\1{n}", _conv(keys).replace(IN, where)) for n, where in (("", _HALF), ("b", _BEFORE)))
    return now + ", " + old


def _period_rates(spark, sf_dir, **more):
    start, end = datetime(2024, 1, 15), datetime(2024, 1, 24, 23, 59, 59, 999000)
    each = [K.conversion(T.base_events(spark, sf_dir), EventSeries("view"), EventSeries("purchase"), *r, 24, **more) for r in ((start, end), previous_range(start, end))]
    return each


@query(
    "WITH " + _two_periods() + ", now AS (SELECT row_number() OVER (ORDER BY date) AS position, rate FROM rates), old AS (SELECT row_number() OVER (ORDER BY date) AS position, rate FROM ratesb) "
    "SELECT CAST(now.position AS INTEGER) AS position, now.rate, old.rate AS previous FROM now LEFT JOIN old ON old.position = now.position"
)
def conversion_previous(spark, sf_dir):
    """The previous period by itself: a view before the cut is not converted by a purchase after it."""
    return K.with_previous_rates(*_period_rates(spark, sf_dir)).select("position", "rate", "previous")


@query(
    "WITH " + _two_periods("region") + """ SELECT region, CAST(sum(total) AS BIGINT) AS total, CAST(sum(conversions) AS BIGINT) AS conversions, floor(sum(CAST(round(rate * 100) AS BIGINT)) / count(*) + 0.5) / 100 AS mean_rate,
    coalesce((SELECT floor(sum(CAST(round(rate * 100) AS BIGINT)) / count(*) + 0.5) / 100 FROM ratesb b WHERE b.region = rates.region), 0) AS previous_mean, coalesce(max(rate) FILTER (strftime(date, '%Y%m%d') = '20240116'), 0) AS d20240116 FROM rates GROUP BY region"""
)
def conversion_table_previous(spark, sf_dir):
    now, before = _period_rates(spark, sf_dir, breakdowns=["region"])
    return C.rate_table(now, ["region"], ["20240116"], before)


@query(
    "WITH " + _conv("region") + """, m AS (SELECT region, floor(sum(CAST(round(rate * 100) AS BIGINT)) / count(*) + 0.5) / 100 AS mean FROM rates GROUP BY region)
    SELECT (SELECT region FROM m ORDER BY mean DESC, region DESC LIMIT 1) AS best_series, max(mean) AS best_mean, (SELECT region FROM m ORDER BY mean, region LIMIT 1) AS worst_series, min(mean) AS worst_mean, floor(sum(CAST(round(mean * 100) AS BIGINT)) / count(*) + 0.5) / 100 AS overall_mean FROM m"""
)
def conversion_series_summary(spark, sf_dir):
    return K.series_summary(_rates(spark, sf_dir, breakdowns=["region"]), ["region"])


@query(
    "WITH tagged AS (SELECT * REPLACE (CASE WHEN utm_source = '' THEN '(not set)' ELSE utm_source END AS utm_source) FROM ev), "
    + _conv("utm_source").replace("FROM ev ", "FROM tagged ")
    + f", chosen AS (SELECT utm_source FROM tagged WHERE name IN ('view', 'purchase') AND {IN} GROUP BY utm_source ORDER BY min(created_at), utm_source LIMIT 2) SELECT strftime(date, '%Y-%m-%d') AS date, rates.utm_source, total, conversions, rate FROM rates SEMI JOIN chosen ON chosen.utm_source = rates.utm_source"
)
def conversion_limit(spark, sf_dir):
    """A property breakdown with '(not set)', the two series seen first."""
    events = T.base_events(spark, sf_dir)
    rates = K.conversion(events, EventSeries("view"), EventSeries("purchase"), START, END, 24, breakdowns=["properties.__query.utm_source"])
    labelled = events.withColumn("utm_source", C.label("properties.__query.utm_source"))
    chosen = Fn.first_labels(labelled, [EventSeries("view"), EventSeries("purchase")], START, END, ["utm_source"], 2)
    return rates.join(chosen, "utm_source", "left_semi").withColumn("date", day("date"))


@query(
    "WITH " + _levels("profile_id", more=", region") + """, counted AS (SELECT region, s AS step, count(*) FILTER (level >= s) AS count FROM levels CROSS JOIN (SELECT unnest([1, 2, 3]) AS s) GROUP BY ALL)
    SELECT region, step, count, CAST(dense_rank() OVER (ORDER BY entered DESC, region) AS INTEGER) AS place FROM (SELECT *, max(count) FILTER (step = 1) OVER (PARTITION BY region) AS entered FROM counted)"""
)
def funnel_by_total(spark, sf_dir):
    steps = Fn.funnel_steps(_funnel(spark, sf_dir, "profile_id", T.base_events(spark, sf_dir), breakdowns=["region"]), 3, ["region"])
    return Fn.by_total(steps, ["region"]).select("region", "step", "count", "place")


@query(
    "WITH " + _levels("profile_id", more=", region") + f", chosen AS (SELECT region FROM ev WHERE name IN ('view', 'click', 'purchase') AND {IN} GROUP BY region ORDER BY min(created_at), region LIMIT 2) "
    "SELECT region, who, level FROM levels SEMI JOIN chosen USING (region)"
)
def funnel_limit(spark, sf_dir):
    events = T.base_events(spark, sf_dir)
    chosen = Fn.first_labels(events, STEPS, START, END, ["region"], 2)
    return _funnel(spark, sf_dir, "profile_id", events.join(chosen, "region", "left_semi"), breakdowns=["region"]).select("region", "who", "level")


_RANKED = f"WITH s AS ({_BROKEN}), m AS (SELECT label_0, label_1, sum(count) AS sum, coalesce(avg(CASE WHEN count <> 0 THEN count END), 0) AS average, min(count) AS min, max(count) AS max, max(total_count) AS total FROM s GROUP BY label_0, label_1)"


def _broken(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("region", "properties.__query.utm_source"))
    return spec, C.chart(T.base_events(spark, sf_dir), spec)


@query(_RANKED + " SELECT md5('0' || chr(31) || label_0 || chr(31) || label_1) AS id, CAST(row_number() OVER (ORDER BY sum DESC, label_0, label_1) AS INTEGER) AS place, 'view' AS name, CAST(0 AS INTEGER) AS def_index, * FROM m QUALIFY place <= 7")
def chart_formatted(spark, sf_dir):
    spec, series = _broken(spark, sf_dir)
    return C.formatted(series, spec, 7)


@query(_RANKED + ", t AS (SELECT label_0, label_1 FROM m ORDER BY sum DESC, label_0, label_1 LIMIT 3) SELECT label_0, label_1, date, count FROM s SEMI JOIN t USING (label_0, label_1)")
def chart_series_limit(spark, sf_dir):
    spec, series = _broken(spark, sf_dir)
    return C.limit_series(series, spec, 3).select("label_0", "label_1", "date", "count").withColumn("date", day("date"))


@query(_RANKED + " SELECT label_0, label_1, sum AS count, round(sum * 100.0::DOUBLE / sum(sum) OVER (), 2) AS share FROM m")
def chart_pie(spark, sf_dir):
    spec, series = _broken(spark, sf_dir)
    return C.shaped(series, spec, "pie").drop("def_index")


@query(f"SELECT country AS label_0, CAST(count(*) AS DOUBLE) AS count FROM ev WHERE name = 'view' AND {IN} GROUP BY country")
def chart_map(spark, sf_dir):
    spec = _spec(EventSeries("view"), breakdowns=("country",))
    return C.shaped(C.chart(T.base_events(spark, sf_dir), spec), spec, "map").drop("def_index")


@query(f"SELECT CAST(i AS INTEGER) AS def_index, CAST(count(*) AS DOUBLE) AS count FROM ev JOIN (VALUES (0, 'view'), (1, 'purchase')) t(i, n) ON n = name WHERE {IN} GROUP BY i")
def chart_metric(spark, sf_dir):
    spec = _spec(EventSeries("view"), EventSeries("purchase"), breakdowns=("region",))
    return C.shaped(C.chart(T.base_events(spark, sf_dir), spec), spec, "metric")


@query(_daily("count(*)", ["view"]).replace("SELECT t.def_index,", "SELECT t.def_index, '' AS label_0,").replace(IN, IN + " AND NOT EXISTS (SELECT 1 FROM ev WHERE region = 'ATLANTIS')"))
def chart_fallback(spark, sf_dir):
    """A breakdown below a filter that nothing meets: the report without breakdowns."""
    events = T.base_events(spark, sf_dir)
    matched = events.filter("region = 'ATLANTIS'")
    spec = _spec(EventSeries("view"), breakdowns=("region",))
    found = C.chart_or_whole(matched, spec)
    return _out(found if found.limit(1).count() else C.chart_or_whole(events.withColumn("region", F.lit("")).filter("name = 'view'"), replace(spec, breakdowns=())).withColumn("label_0", F.lit("")), 1)


_ZONE = "Europe/Stockholm"
_LOCAL = "(created_at + INTERVAL 66 DAY) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Stockholm'"
_ZONED = f"SELECT *, {_LOCAL} AS t FROM ev WHERE name = 'view'"


def _spring(spark, sf_dir):
    """The events moved to March, so that the clock changes among them."""
    return T.base_events(spark, sf_dir).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 66 DAYS"))


@query(
    f"""WITH z AS ({_ZONED}), c AS (SELECT date_trunc('day', t) AS date, count(DISTINCT profile_id) AS n FROM z WHERE t BETWEEN TIMESTAMP '2024-03-25' AND TIMESTAMP '2024-04-03 23:59:59' GROUP BY 1)
    SELECT strftime(g.date, '%Y-%m-%d') AS date, CAST(coalesce(n, 0) AS DOUBLE) AS count, (SELECT count(DISTINCT profile_id) FROM z WHERE t BETWEEN TIMESTAMP '2024-03-25' AND TIMESTAMP '2024-04-03 23:59:59') AS total_count
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-03-25', TIMESTAMP '2024-04-03', INTERVAL 1 DAY)) AS date) g LEFT JOIN c ON CAST(c.date AS TIMESTAMP) = g.date"""
)
def chart_zone_daily(spark, sf_dir):
    """Days of a zone in which the clock changes."""
    spec = ReportSpec((EventSeries("view", "user"),), datetime(2024, 3, 25), datetime(2024, 4, 3, 23, 59, 59), tz=_ZONE)
    return C.chart(_spring(spark, sf_dir), spec).select(day("date").alias("date"), "count", "total_count")


@query(
    f"""WITH z AS ({_ZONED}), c AS (SELECT date_trunc('hour', t) AS date, count(*) AS n FROM z WHERE t BETWEEN TIMESTAMP '2024-03-30' AND TIMESTAMP '2024-03-31 23:59:59' GROUP BY 1)
    SELECT strftime(g.date, '%Y-%m-%d %H:%M:%S') AS date, CAST(coalesce(n, 0) AS DOUBLE) AS count FROM (SELECT unnest(generate_series(TIMESTAMP '2024-03-30', TIMESTAMP '2024-03-31 23:00:00', INTERVAL 1 HOUR)) AS date) g LEFT JOIN c ON c.date = g.date"""
)
def chart_zone_hourly(spark, sf_dir):
    spec = ReportSpec((EventSeries("view"),), datetime(2024, 3, 30), datetime(2024, 3, 31, 23, 59, 59), interval="hour", tz=_ZONE)
    return C.chart(_spring(spark, sf_dir), spec).select(text("date").alias("date"), "count")


@query(f"WITH z AS (SELECT *, {_LOCAL} AS t FROM ev) SELECT name, count(*) AS n, strftime(date_trunc('week', t), '%Y-%m-%d') AS week, strftime(date_trunc('month', t), '%Y-%m-%d') AS month FROM z WHERE t BETWEEN TIMESTAMP '2024-03-27' AND TIMESTAMP '2024-04-03 23:59:59.999' GROUP BY ALL")
def zone_named_range(spark, sf_dir):
    """The last seven days as people of the zone count them, at half past ten in the evening by UTC."""
    start, end = named_range("7d", datetime(2024, 4, 2, 22, 30), _ZONE)
    rows = _spring(spark, sf_dir).filter(between("created_at", start, end, _ZONE))
    week, month = (day(bucket(F.col("created_at"), unit, tz=_ZONE)).alias(unit) for unit in ("week", "month"))
    return rows.groupBy("name", week, month).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT 'release' AS title, '2024-01-10' AS date, CAST(count(*) AS BIGINT) AS events FROM ev WHERE project_id = 'p0' AND CAST(created_at AS DATE) = DATE '2024-01-10' UNION ALL "
    "SELECT 'campaign', '2024-01-20', count(*) FROM ev WHERE project_id = 'p0' AND CAST(created_at AS DATE) = DATE '2024-01-20'"
)
def chart_references(spark, sf_dir):
    """Annotations inside a chart's range, beside the events of their day."""
    made = [("release", "2024-01-10", "p0"), ("campaign", "2024-01-20", "p0"), ("early", "2024-01-02", "p0"), ("foreign", "2024-01-12", "p1")]
    marks = spark.createDataFrame(made, "title string, at string, project_id string").withColumn("date", F.to_timestamp("at"))
    shown = C.references_in(marks, _spec(EventSeries("*"), project_id="p0"))
    per_day = T.base_events(spark, sf_dir).groupBy("project_id", F.to_date("created_at").cast("string").alias("at")).agg(F.count(F.lit(1)).alias("events"))
    return shown.join(per_day, ["project_id", "at"], "left").select("title", F.col("at").alias("date"), F.coalesce("events", F.lit(0)).alias("events"))


def _cohort(keep, unit="day", days=1):
    return f"""daily AS (SELECT DISTINCT project_id, name, CAST(created_at AS DATE) AS day, profile_id FROM ev WHERE profile_id <> device_id),
    cohorts AS (SELECT DISTINCT project_id, profile_id, CAST(date_trunc('{unit}', day) AS DATE) AS cohort FROM daily WHERE name = 'view'),
    later AS (SELECT DISTINCT project_id, profile_id, day AS seen FROM daily WHERE name = 'purchase'),
    reached AS (SELECT cohort, project_id, profile_id, date_diff('day', cohort, CAST(date_trunc('{unit}', seen) AS DATE)) // {days} AS x FROM cohorts JOIN later USING (project_id, profile_id) WHERE seen >= cohort AND seen <= cohort + {7 * days}),
    sizes AS (SELECT cohort, count(*) AS size FROM cohorts GROUP BY cohort),
    matrix AS (SELECT s.cohort, s.size, g.x, count(DISTINCT r.project_id || r.profile_id) AS users FROM sizes s CROSS JOIN (SELECT unnest(range(8))::INTEGER AS x) g LEFT JOIN reached r ON r.cohort = s.cohort AND r.x {keep} g.x GROUP BY ALL)"""


@query("WITH " + _cohort(">=") + " SELECT * FROM matrix")
def cohort_on_or_after(spark, sf_dir):
    return K.cohort_matrix(K.cohort_events(T.base_events(spark, sf_dir)), "view", "purchase")


@query("WITH " + _cohort("=", "week", 7) + " SELECT * FROM matrix")
def cohort_on(spark, sf_dir):
    return K.cohort_matrix(K.cohort_events(T.base_events(spark, sf_dir)), "view", "purchase", "week", on_or_after=False)


@query("WITH " + _cohort(">=") + " SELECT x, CASE WHEN sum(size) FILTER (users <> 0) IS NULL THEN 0 ELSE round(sum(users) FILTER (users <> 0)::DOUBLE / sum(size) FILTER (users <> 0) * 100, 2) END AS percent FROM matrix GROUP BY x")
def cohort_weighted(spark, sf_dir):
    return K.weighted_average(K.cohort_matrix(K.cohort_events(T.base_events(spark, sf_dir)), "view", "purchase"))


@query("WITH " + _cohort(">=") + " SELECT *, CASE WHEN size = 0 THEN 0 ELSE round(users * 100.0::DOUBLE / size, 2) END AS percent FROM matrix")
def cohort_percent(spark, sf_dir):
    return K.with_percentages(K.cohort_matrix(K.cohort_events(T.base_events(spark, sf_dir)), "view", "purchase"))


@query(
    """WITH daily AS (SELECT DISTINCT project_id, name, CAST(created_at + to_days(CAST(event_id % 4 * 30 AS INTEGER)) AS DATE) AS day, profile_id FROM ev WHERE profile_id <> device_id),
    cohorts AS (SELECT DISTINCT project_id, profile_id, CAST(date_trunc('month', day) AS DATE) AS cohort FROM daily WHERE name = 'view'),
    later AS (SELECT DISTINCT project_id, profile_id, day AS seen FROM daily WHERE name = 'purchase'),
    reached AS (SELECT cohort, project_id, profile_id, date_diff('month', cohort, seen) AS x FROM cohorts JOIN later USING (project_id, profile_id) WHERE seen >= cohort AND seen <= cohort + INTERVAL 3 MONTH),
    sizes AS (SELECT cohort, count(*) AS size FROM cohorts GROUP BY cohort)
    SELECT s.cohort, s.size, g.x, count(DISTINCT r.project_id || r.profile_id) AS users FROM sizes s CROSS JOIN (SELECT unnest(range(4))::INTEGER AS x) g LEFT JOIN reached r ON r.cohort = s.cohort AND r.x = g.x GROUP BY ALL"""
)
def cohort_month(spark, sf_dir):
    """Months, on events spread over four of them."""
    spread = T.base_events(spark, sf_dir).withColumn("created_at", F.col("created_at") + F.make_dt_interval(days=(F.col("event_id") % 4 * 30).cast("int")))
    return K.cohort_matrix(K.cohort_events(spread), "view", "purchase", "month", 3, on_or_after=False)


_WEEK = "CAST(date_trunc('week', {} + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE)"


@query(
    f"WITH s AS (SELECT {_WEEK.format('min(created_at)')} AS a, {_WEEK.format('max(created_at)')} AS b FROM ev GROUP BY project_id, profile_id) SELECT a AS first_week, "
    + ", ".join(f"count(*) FILTER (date_diff('day', a, b) // 7 = {i}) AS period_{i}" for i in range(10)) + " FROM s GROUP BY a"
)
def retention_weekly_table(spark, sf_dir):
    return K.weekly_table(T.base_events(spark, sf_dir))


@query(
    f"WITH a AS (SELECT DISTINCT project_id, profile_id, {_WEEK.format('created_at')} AS week FROM ev) SELECT a.week, count(*) AS active, count(b.week) AS retained, "
    "round(count(b.week) * 100.0::DOUBLE / count(*), 2) AS retention FROM a LEFT JOIN a b ON a.project_id = b.project_id AND a.profile_id = b.profile_id AND b.week = a.week + 7 GROUP BY a.week"
)
def retention_series(spark, sf_dir):
    return K.weekly_retention(T.base_events(spark, sf_dir))


@query(
    "WITH d AS (SELECT DISTINCT project_id, CAST(created_at AS DATE) AS day, profile_id FROM ev), x AS (SELECT project_id, profile_id, CAST(day + i AS DATE) AS date FROM d CROSS JOIN (SELECT unnest(range(7))::INTEGER AS i)) "
    "SELECT date, count(DISTINCT project_id || profile_id) AS users FROM x GROUP BY date"
)
def rolling_active(spark, sf_dir):
    return K.rolling_active(K.daily_profiles(T.base_events(spark, sf_dir)), 7)


@query()
def hll_rolling_active(spark, sf_dir):
    return K.rolling_active_approx(K.daily_sketches(T.base_events(spark, sf_dir)), 7)


@query("WITH d AS (SELECT DISTINCT project_id, profile_id, CAST(created_at AS DATE) AS day FROM ev), s AS (SELECT project_id, profile_id, day + CAST(n AS INTEGER) AS date FROM d, range(7) t(n)) SELECT date, count(DISTINCT (project_id, profile_id)) AS users, true AS near FROM s GROUP BY date")
def hll_against_exact(spark, sf_dir):
    """Exact rolling counts, and whether the sketches come within 5 % (or one) of them."""
    events = T.base_events(spark, sf_dir)
    week = F.expr("sequence(day, date_add(day, 6), interval 1 day)")
    exact = K.daily_profiles(events).withColumn("date", F.explode(week)).groupBy("date").agg(F.count_distinct("project_id", "profile_id").alias("users"))
    near = K.rolling_active_approx(K.daily_sketches(events), 7).withColumnRenamed("users", "estimate")
    return exact.join(near, "date", "full").select("date", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.05)).alias("near"))


@query("WITH l AS (SELECT max(created_at) AS t FROM ev GROUP BY project_id, profile_id) SELECT CAST(date_diff('day', CAST(t AS DATE), DATE '2024-01-28') AS INTEGER) AS days, count(*) AS users FROM l GROUP BY 1")
def last_seen(spark, sf_dir):
    return K.days_since_seen(T.base_events(spark, sf_dir), AS_OF)
