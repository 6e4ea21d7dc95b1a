"""Work on long keys that is done by slices of time, and what else must not gather a key in one task."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from trailmark.operators.charts import limit_series
from trailmark.operators.cohorts import rolling_active
from trailmark.operators.funnel import funnel_levels
from trailmark.operators.sessions import sessionize, sessionize_sliced, view_duration, view_duration_sliced
from trailmark.plans.spec import EventSeries, ReportSpec
from trailmark.sources import tables as T

T0 = datetime(2024, 1, 1, 22)


def test_sliced_sessions_equal_whole_ones(spark):
    """Sessions within, across and over whole slices, ties at a border, silent slices, two projects with one device."""
    rng, rows = random.Random(4), []
    for project, device, n, most in (("p", "hot", 600, 40), ("p", "calm", 40, 500), ("q", "hot", 60, 90), ("p", "one", 1, 1)):
        minutes = 0
        for _ in range(n):
            minutes += rng.choice([0, 0, 5, 29, 30, 31, rng.randint(1, most)])
            rows.append((len(rows), project, device, rng.choice(["screen_view", "click"]), T0 + timedelta(minutes=minutes)))
    events = spark.createDataFrame(rows, "event_id long, project_id string, device_id string, name string, created_at timestamp")
    plain = {r.event_id: (r.session_id, r.duration) for r in view_duration(sessionize(events)).collect()}
    for seconds in (600, 3600, 86400):
        found = view_duration_sliced(sessionize_sliced(events, 1800, seconds), slice_seconds=seconds)
        assert {r.event_id: (r.session_id, r.duration) for r in found.collect()} == plain
        assert found.columns == view_duration(sessionize(events)).columns
    assert sessionize_sliced(events.limit(0)).count() == 0


def reached(pairs, steps):
    """The deepest step by taking the earliest time that fits, one step after the other."""
    last = None
    for i in range(1, steps + 1):
        times = [t for t, s in pairs if s == i and (last is None or t > last)]
        if not times:
            return i - 1
        last = min(times)
    return steps


def test_funnel_without_window_by_slices(spark):
    rng = random.Random(5)
    names = ["a", "b", "c", "d"]
    keys = {f"k{i}": [(rng.randint(0, 12), rng.randint(1, 4)) for _ in range(rng.randint(1, 14))] for i in range(300)}
    rows = [("p", k, names[s - 1], T0 + timedelta(hours=t)) for k, pairs in keys.items() for t, s in pairs]
    schema = "project_id string, session_id string, name string, created_at timestamp"
    events = spark.createDataFrame(rows, schema)
    steps = [EventSeries(n) for n in names]
    want = {k: n for k, pairs in keys.items() if (n := reached(pairs, 4))}
    for hours in (1, 3, 1000):
        levels = funnel_levels(events, steps, T0, T0 + timedelta(days=9), None, slice_hours=hours)
        assert {r.who: r.level for r in levels.collect()} == want


def test_a_long_key_of_a_funnel(spark):
    """100,000 events of one key, its steps a day apart in the wrong order but for one chain."""
    n = F.col("id")
    day = F.floor(n / 10000)
    name = F.when(n == 15000, "a").when(n == 55000, "b").when(day == 0, "c").when(day == 1, "b").when(n == 99999, "c").otherwise("a")
    events = spark.range(100_000, numPartitions=8).select(
        F.lit("p").alias("project_id"), F.lit("hot").alias("session_id"), name.alias("name"), (F.lit(T0) + F.make_dt_interval(days=day.cast("int"), secs=(n % 10000).cast("int"))).alias("created_at")
    )
    levels = funnel_levels(events, [EventSeries(x) for x in "abc"], T0, T0 + timedelta(days=20), None)
    assert [(r.who, r.level) for r in levels.collect()] == [("hot", 3)]


def test_rolling_active_by_runs(spark):
    rng = random.Random(7)
    rows = {(rng.choice("pq"), f"u{rng.randint(0, 6)}", date(2024, 1, 1) + timedelta(days=rng.choice([rng.randint(0, 20), rng.randint(50, 60)]))) for _ in range(90)}
    daily = spark.createDataFrame(sorted(rows), "project_id string, profile_id string, day date")
    for n in (1, 7, 30):
        want = {}
        for project, profile, day in rows:
            for k in range(n):
                want.setdefault(day + timedelta(days=k), set()).add((project, profile))
        assert {r.date: r.users for r in rolling_active(daily, n).collect()} == {d: len(who) for d, who in want.items()}


def test_limit_series_keeps_points(spark):
    rows = [(s, "x" if s % 2 else None, date(2024, 1, d), float(s * d)) for s in range(6) for d in range(1, 5)]
    series = spark.createDataFrame(rows, "def_index int, label_0 string, date date, count double")
    spec = ReportSpec(series=[EventSeries("a")], start=T0, end=T0 + timedelta(days=4), breakdowns=["country"])
    got = limit_series(series, spec, 2)
    assert got.columns == series.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([r for r in rows if r[0] >= 4], key=str)


def test_lookup_reads_one_day(spark, tmp_path):
    """Folders by project and time, row groups by the Bloom filter of ids."""
    n = F.col("id")
    rows = spark.range(3000).select(F.sha2(n.cast("string"), 256).alias("id"), F.concat(F.lit("p"), (n % 2).cast("string")).alias("project_id"), (F.lit(T0) + F.make_dt_interval(hours=(n % 240).cast("int"))).alias("created_at"))
    T.write_days(rows.withColumn("event_date", F.to_date("created_at")), str(tmp_path / "t"), ["id"])
    wanted = [r.id for r in rows.filter("project_id = 'p1' AND to_date(created_at) = DATE '2024-01-05'").limit(3).collect()]
    found = T.stored_by_id(spark, str(tmp_path), "t", wanted, datetime(2024, 1, 5, 12), 11.9, "p1")
    assert sorted(r.id for r in found.collect()) == sorted(wanted)
    assert {r[0].split("/")[-3:-1][1] for r in found.select(F.input_file_name()).collect()} == {"event_date=2024-01-05"}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    folders, rows_of = plan.split("PartitionFilters: [")[1].split("PushedFilters: ")
    assert "event_date" in folders and "project_id" in folders and "In(id" in rows_of
    assert T.stored_by_id(spark, str(tmp_path), "t", wanted).count() == 3
    assert T.stored_by_id(spark, str(tmp_path), "t", ["none"], datetime(2024, 1, 5)).count() == 0
    path = found.select(F.input_file_name().alias("f")).first().f
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    columns = {c.getPath().toDotString(): c.getBloomFilterOffset() for b in reader.getFooter().getBlocks() for c in b.getColumns()}
    reader.close()
    assert columns["id"] > 0 >= columns["created_at"]
