"""Session rows in full from a stream, and funnel rules that are checked when a session is over."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import where
from ..functions.flatten import render
from ..plans.spec import EventSeries
from .buckets import fold_keys

TAGS = ("source", "medium", "campaign", "content", "term")
_FIRST = ("referrer", "country", "region", *[f"utm_{k}" for k in TAGS])  # as the first event tells them
_TEXTS = ("profile_id", "entry_path", "entry_origin", "exit_path", "exit_origin", *_FIRST)
_NUMBERS = ("first_us", "last_us", "screen_view_count", "event_count", "revenue", "version")
LOG = "project_id string, device_id string, id string, " + ", ".join([f"{c} string" for c in _TEXTS] + [f"{c} long" for c in _NUMBERS]) + ", duration long, is_bounce boolean, sign int"
_COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def _told(key: tuple, held: dict, sign: int) -> tuple:
    whole = {**held, "project_id": key[0], "device_id": key[1], "id": f"{key[1]}-{held['first_us']}", "sign": sign}
    whole |= {"duration": held["last_us"] // 1000 - held["first_us"] // 1000, "is_bounce": held["screen_view_count"] <= 1}
    return tuple(whole[c] for c in _COLUMNS)


def _take(held: dict | None, event: dict, device: str, view: str) -> dict:
    """The session with one more event; None opens one."""
    place = (event["us"], event["event_id"])
    if held is None:
        held = {"profile_id": device, "version": 1, "screen_view_count": 0, "event_count": 0, "revenue": 0}
        begins = ends = True
    else:
        begins, ends = place < (held["first_us"], held["first_event"]), place >= (held["last_us"], held["last_event"])
    new = dict(held)
    if begins:
        new |= {"first_us": place[0], "first_event": place[1], "entry_path": event["path"], "entry_origin": event["origin"], **{c: event[c] for c in _FIRST}}
    if ends:
        new |= {"last_us": place[0], "last_event": place[1], "exit_path": event["path"], "exit_origin": event["origin"]}
    if event["profile_id"] and event["profile_id"] != device:
        new["profile_id"] = event["profile_id"]
    new["screen_view_count" if event["name"] == view else "event_count"] += 1
    new["revenue"] += event["revenue"]
    return new


def session_log(events: DataFrame, stored: DataFrame | None = None, gap_minutes: int = 30, ttl_minutes: int = 60, delay: str = "30 minutes", view: str = "screen_view") -> DataFrame:
    """Session rows with all columns of ``operators.sessions.session_rows`` as a signed log with versions.

    Each batch withdraws (-1) the version of a session that it replaces and adds (+1) the new one; ``collapse`` makes the last
    versions.  ``stored`` is a stream of session rows (with ids of their start, and a version): what the fold knows of a device
    before its first event.  Stored rows are taken before the events of their batch, and only by devices that have no
    session, so a row that comes again changes nothing.  A session is forgotten ``ttl_minutes`` (at least the gap) after its last
    event, by the watermark; its device's next event opens another, and what came too late for that is dropped by Spark.
    Within a batch events are put in order; a session keeps the person that was told last.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    tags = [F.coalesce(F.element_at("properties", f"__query.utm_{k}"), F.lit("")).alias(f"utm_{k}") for k in TAGS]
    rows = events.select(
        "project_id", "device_id", "created_at", *map(text, ("profile_id", "name", "path", "origin", "referrer", "country", "region")), *tags,
        "event_id", F.coalesce("revenue", F.lit(0)).cast("long").alias("revenue"), F.lit("").alias("known"),
    )
    if stored is not None:
        rows = rows.unionByName(_known(stored), allowMissingColumns=True)
    gap, keep = gap_minutes * 60_000_000, max(gap_minutes, ttl_minutes) * 60_000_000

    def step(key: tuple, rows: list[tuple] | None, held: dict | None, mark: int, out: list[tuple]):
        if rows is None:
            return None
        told = held
        before = [known for *_, known in rows if known]
        if held is None and before:
            held = told = max(map(json.loads, before), key=lambda s: s["last_us"])
        for row in rows:
            if row[-1]:
                continue
            event = dict(zip(names, row))
            if held and event["us"] - held["last_us"] > gap:
                if held is not told:
                    out.append(_told(key, held, 1))
                held = told = None
            elif held is not None and held is told:  # the first event of this batch that changes what has been told
                out.append(_told(key, held, -1))
                held = {**held, "version": held["version"] + 1}
            held = _take(held, event, key[1], view)
        if held is not told:
            out.append(_told(key, held, 1))
        return held, max((held["last_us"] + keep) // 1000, mark + 1)

    rows = rows.withColumns({"id": F.col("event_id").cast("string"), "event_id": F.coalesce("event_id", F.lit(0)), "revenue": F.coalesce("revenue", F.lit(0))})
    timed = rows.withWatermark("created_at", delay).withColumn("us", F.unix_micros("created_at"))
    values = ("profile_id", "name", "path", "origin", *_FIRST, "event_id", "revenue", "known")
    names = ("us", "id", *values)
    log = fold_keys(timed, ("project_id", "device_id"), values, step, LOG)
    times = {"first_us": "created_at", "last_us": "ended_at"}
    return log.select(*[F.timestamp_micros(c).alias(times[c]) if c in times else F.col(c) for c in log.columns])


def _known(stored: DataFrame) -> DataFrame:
    """Session rows as the fold holds them."""
    least = F.lit(-(1 << 62))
    made = {"first_us": F.unix_micros("created_at"), "last_us": F.unix_micros("ended_at"), "first_event": least, "last_event": least}
    fields = [made.get(c, F.coalesce(F.col(c), F.lit("")) if c in _TEXTS else F.col(c)).alias(c) for c in (*_TEXTS, *_NUMBERS, "first_event", "last_event") if c in made or c in stored.columns]
    return stored.select("project_id", "device_id", F.col("ended_at").alias("created_at"), F.to_json(F.struct(*fields)).alias("known"))


FIRED = "project_id string, device_id string, opened long, rule string, names array<string>, paths array<string>, times array<long>"


def funnel_rules(
    events: DataFrame, rules: dict[str, tuple[list[EventSeries], str]], gap_minutes: int = 30, delay: str | None = "30 minutes"
) -> DataFrame:
    """project_id, device_id, session_start, rule, title, events: rules whose steps a session went through, told when it is over.

    Each event moves a rule on by a step at most, if it has the name of the next step and meets its filters.  The state of
    a session is one place for each rule and what was met so far, so it does not grow with the session.  Events are taken
    in order within a batch; of a late one only what it moves on counts.  Titles know {{rule}}, {{names}} (all steps), {{first}}
    and {{path}} (of the last step).
    """
    names, sizes = list(rules), {rule: len(steps) for rule, (steps, _) in rules.items()}
    met = [
        F.when((F.lit(s.name == "*") | (F.col("name") == s.name)) & where(s.filters, negation="all"), F.lit(f"{r}:{i}"))
        for r, rule in enumerate(names)
        for i, s in enumerate(rules[rule][0])
    ]
    gap = gap_minutes * 60_000_000

    def step(key: tuple, rows: list[tuple] | None, held: list | None, mark: int, out: list[tuple]):
        opened, last, reached = held or (None, None, {})

        def close() -> None:
            for rule in names:
                steps = reached.get(rule, [])
                if len(steps) == sizes[rule]:
                    out.append((*key, opened, rule, *[list(x) for x in zip(*steps)]))

        if rows is None:
            return close()
        for now, _, name, path, hits in rows:
            if opened is not None and now - last > gap:
                close()
                opened, reached = None, {}
            opened, last = (now, now) if opened is None else (min(opened, now), max(last, now))
            if hits:
                due = {f"{r}:{len(reached.get(rule, []))}": rule for r, rule in enumerate(names)}
                for hit in hits.split(" "):
                    if hit in due:
                        reached.setdefault(due[hit], []).append((name, path, now))
        return (opened, last, reached), max((last + gap) // 1000, mark + 1)

    timed = events.withWatermark("created_at", delay) if delay else events
    placed = timed.withColumn("us", F.unix_micros("created_at")).withColumn("met", F.concat_ws(" ", *met))
    fired = fold_keys(placed, ("project_id", "device_id"), ("name", "path", "met"), step, FIRED)
    told = {"rule": F.col("rule"), "names": F.concat_ws(" > ", "names"), "first": F.element_at("names", 1), "path": F.element_at("paths", -1)}
    titles = F.coalesce(*[F.when(F.col("rule") == rule, render(F.lit(template), told)) for rule, (_, template) in rules.items()])
    steps = F.transform(F.arrays_zip("names", "paths", "times"), lambda x: F.struct(x["names"].alias("name"), x["paths"].alias("path"), F.timestamp_micros(x["times"]).alias("created_at")))
    return fired.select("project_id", "device_id", F.timestamp_micros("opened").alias("session_start"), "rule", titles.alias("title"), steps.alias("events"))


CARRIED = "project_id string, id string, device_id string, session_device string, session_id string, us long"


def sessions_over_midnight(events: DataFrame, gap_minutes: int = 30, delay: str = "30 minutes") -> DataFrame:
    """Each event with the session that it belongs to, where device ids change every midnight.

    Events carry device_id, previous_device_id (under the salt of the day before) and visitor, by which state is
    kept and which does not leave it.  An open session goes on if either id is the one that it began with; a session is
    handed over once, as after a second midnight neither is.  State is gone a gap after the last event.  Late events that
    the watermark lets through join the open session, or become one of their own if it began more than a gap later.
    """
    gap = gap_minutes * 60_000_000

    def step(key: tuple, rows: list[tuple] | None, held: list | None, mark: int, out: list[tuple]):
        """Holds device, opened, last."""
        if rows is None:
            return None
        for now, row, device, previous in rows:
            goes_on = held and held[0] in (device, previous) and held[1] - gap <= now <= held[2] + gap
            session = (held[0], held[1], max(held[2], now)) if goes_on else (device, now, now)
            if held is None or now >= held[1]:
                held = session
            out.append((key[0], row, device, session[0], f"{session[0]}-{session[1]}", now))
        return held, max((held[2] + gap) // 1000 + 1, mark + 1)

    placed = events.withWatermark("created_at", delay).withColumn("us", F.unix_micros("created_at"))
    told = fold_keys(placed, ("project_id", "visitor"), ("device_id", "previous_device_id"), step, CARRIED)
    return told.withColumn("created_at", F.timestamp_micros("us")).drop("us")
