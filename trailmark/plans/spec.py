"""What a chart asks for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from ..functions.filters import Filter

SEGMENTS = ("event", "user", "session", "user_average", "one_event_per_user", "property_sum", "property_average", "property_max", "property_min")


@dataclass(frozen=True)
class EventSeries:
    """Events of one name ('*': any), counted by a segment."""

    name: str
    segment: str = "event"
    property: str = ""
    filters: tuple[Filter, ...] = ()

    def __post_init__(self):
        if self.segment not in SEGMENTS:
            raise ValueError(f"no such segment: {self.segment}")


@dataclass(frozen=True)
class FormulaSeries:
    """Arithmetic over the series before it, called A, B, ..."""

    formula: str


@dataclass(frozen=True)
class ReportSpec:
    series: tuple[EventSeries | FormulaSeries, ...]
    start: datetime
    end: datetime
    interval: str = "day"
    breakdowns: tuple[str, ...] = ()
    limit: int | None = None  # breakdown tuples, by number of events
    week_start: str = "monday"
    tz: str = "UTC"  # of start, end and the buckets
    project_id: str | None = None
    filters: tuple[Filter, ...] = field(default=())
