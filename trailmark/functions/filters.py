"""Filters on events, sessions and profiles, compiled to Column predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .props import is_wildcard, resolve, wildcard_values

NUMERIC_COLUMNS = {"duration", "revenue", "longitude", "latitude"}
OPERATORS = ("is", "isNot", "contains", "doesNotContain", "startsWith", "endsWith", "regex", "isNull", "isNotNull", "gt", "lt", "gte", "lte")


@dataclass(frozen=True)
class Filter:
    name: str
    operator: str
    value: tuple = ()

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"no such operator: {self.operator}")


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _single(f: Filter, c: Column, negation: str) -> Column:
    """The predicate on one value."""
    values = [str(v).strip() for v in f.value]
    of_property = "properties." in f.name
    any_of = lambda make: reduce(or_, map(make, values))
    none_of = lambda make: reduce(and_ if negation == "all" else or_, [~make(v) for v in values])
    match f.operator:
        case "is":
            return c.cast("string").isin(values)
        case "isNot":
            return ~c.cast("string").isin(values)
        case "contains":
            return any_of(lambda v: c.like(f"%{v}%"))
        case "doesNotContain":
            return none_of(lambda v: c.like(f"%{v}%"))
        case "startsWith":
            return any_of(lambda v: c.like(f"{v}%"))
        case "endsWith":
            return any_of(lambda v: c.like(f"%{v}"))
        case "regex":
            return any_of(lambda v: c.rlike(v if of_property else v.removeprefix("/").removesuffix("/")))
        case "isNull":
            return (c == "") | c.isNull()
        case "isNotNull":
            return (c != "") & c.isNotNull()
    compare = {"gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}[f.operator]
    if of_property or f.name in NUMERIC_COLUMNS:
        return any_of(lambda v: compare(_number(c), _number(F.lit(v))))
    return any_of(lambda v: compare(c, F.lit(v)))


def predicate(f: Filter, negation: str = "any") -> Column | None:
    """The predicate of one filter; None if it says nothing (no values).

    Several values of a negated text operator are joined by OR, so a row passes
    if it avoids any of them; ``negation="all"`` asks it to avoid all.
    """
    if not f.value and f.operator not in ("isNull", "isNotNull"):
        return None
    if f.name == "has_profile":
        identified = F.col("profile_id") != F.col("device_id")
        return identified if str(f.value[0]) == "true" else ~identified
    if is_wildcard(f.name):
        held = wildcard_values(f.name)
        if f.operator == "isNull":
            return F.size(held) == 0
        if f.operator == "isNotNull":
            return F.size(held) > 0
        return F.exists(held, lambda v: _single(f, v, negation))
    return _single(f, resolve(f.name), negation)


def where(filters: Sequence[Filter], negation: str = "any") -> Column:
    """All filters together."""
    return reduce(and_, [p for f in filters if (p := predicate(f, negation)) is not None], F.lit(True))


def needs_profile(filters: Sequence[Filter]) -> bool:
    return any(f.name.startswith("profile.") for f in filters)


#: How event columns are called on session rows.
SESSION_NAMES = {"path": "entry_path", "origin": "entry_origin"} | {
    f"properties.__query.utm_{k}": f"utm_{k}" for k in ("source", "medium", "campaign", "content", "term")
}


def on_sessions(filters: Sequence[Filter]) -> list[Filter]:
    """The same filters for session rows."""
    return [Filter(SESSION_NAMES.get(f.name, f.name), f.operator, f.value) for f in filters]


def search(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive search in several columns."""
    return reduce(or_, [F.col(c).ilike(f"%{text}%") for c in columns])
