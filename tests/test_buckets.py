"""State kept in buckets of keys: few groups, a deadline for each key, order by time and id."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.streaming import sessions as SS
from trailmark.streaming import streams as S

T0 = datetime(2024, 1, 1, 10)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def events(spark, rows):
    return spark.createDataFrame([(str(i), name, "p", d, d, at(m), "/", "o", 0) for i, name, d, m in rows], S.STREAM_SCHEMA)


def known(rows):
    wide = rows.select("*", *[F.lit("").alias(c) for c in ("referrer", "country", "region")], F.col("id").cast("long").alias("event_id"))
    return wide.withColumn("properties", F.create_map().cast("map<string,string>"))


def people(rows):
    none = F.create_map().cast("map<string,string>")
    return rows.select("project_id", F.col("device_id").alias("id"), "created_at", none.alias("fields"), none.alias("properties"), F.create_map(F.lit("n"), F.lit(1.0)).alias("by"))


STREAMS = {
    "marks": S.session_marks,
    "changelog": S.session_changelog,
    "notices": S.visitor_notices,
    "profiles": lambda rows: S.profile_changes(people(rows)),
    "rows": lambda rows: SS.session_log(known(rows)),
    "rules": lambda rows: SS.funnel_rules(rows, {"r": ([S.EventSeries("view")], "{{rule}}")}),
    "midnight": lambda rows: SS.sessions_over_midnight(rows.withColumn("previous_device_id", F.lit("")).withColumn("visitor", F.col("device_id"))),
    "views": lambda rows: S.held_views(rows.withColumn("session_id", F.col("device_id")), view="view"),
}


@pytest.mark.parametrize("name", STREAMS)
def test_groups_do_not_grow_with_keys(spark, tmp_path, name):
    """Of 900 keys Spark keeps a bounded number of groups."""
    folder = str(tmp_path / "in")
    events(spark, [(k, "view", f"d{k}", 0) for k in range(900)]).write.parquet(folder)
    stream = STREAMS[name](spark.readStream.schema(S.STREAM_SCHEMA).parquet(folder))
    query = S.write_batches(stream, S.append_once(str(tmp_path / "out")), str(tmp_path / "c"))
    query.awaitTermination(120)
    groups = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    assert 0 < groups < 600


def test_keys_of_a_bucket_end_one_by_one(spark, monkeypatch):
    """d1 falls silent beside d2, which goes on in the same bucket; both ways to be called find it."""
    from trailmark.streaming import buckets

    monkeypatch.setattr(buckets, "BUCKETS", 1)
    slices = [[(1, "view", "d1", 0), (2, "view", "d2", 0)], [(3, "view", "d2", 25)], [(4, "view", "d2", 50)], [(5, "view", "d2", 75)]]
    marks = S.replay(spark, [events(spark, rows) for rows in slices], lambda e: S.session_marks(e, view="view"))
    got = sorted((r.device_id, r.name, r.views) for r in marks.collect())
    assert got == [("d1", "session_end", 1), ("d1", "session_start", 0), ("d2", "session_start", 0)]


def held(spark, slices):
    views = S.replay(spark, [events(spark, rows) for rows in slices], lambda e: S.held_views(e.withColumn("session_id", F.col("device_id")), view="view"))
    return sorted((r.id, r.duration_ms) for r in views.collect())


def test_held_views_wait_by_all_events(spark):
    """A view comes out after its wait, though only other events tell the time; equal times go by number."""
    assert held(spark, [[(9, "view", "d1", 0), (10, "view", "d1", 0), (11, "view", "d1", 5)], [(12, "click", "d2", 100)]]) == [("10", 300_000), ("11", 0), ("9", 0)]
