"""From property names to columns.

A name is a column (``path``), ``has_profile``, an event property
(``properties.k``), a profile property (``profile.properties.plan``) or field
(``profile.email``), or a pattern over property keys (``properties.items.*.id``).
A missing key yields ''.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_wildcard(name: str) -> bool:
    return "*" in name and ".properties." in f".{name}"


def _map(name: str) -> tuple[str, str]:
    owner, _, key = name.rpartition("properties.") if not name.startswith("properties.") else ("", "", name[len("properties.") :])
    return ("profile_properties" if owner else "properties"), key


def key_pattern(key: str) -> str:
    """A regular expression for keys: * stands for one or more characters."""
    return "^" + ".+".join(re.escape(part) for part in key.split("*")) + "$"


def wildcard_values(name: str) -> Column:
    """The values of all matching keys, trimmed."""
    column, key = _map(name)
    matching = F.map_filter(F.col(column), lambda k, v: k.rlike(key_pattern(key)))
    return F.transform(F.map_values(matching), lambda v: F.trim(v))


def resolve(name: str) -> Column:
    """The column that a property name stands for."""
    if name == "has_profile":
        return F.when(F.col("profile_id") != F.col("device_id"), F.lit("true")).otherwise(F.lit("false"))
    if "properties." in name:
        column, key = _map(name)
        return F.coalesce(F.element_at(F.col(column), key), F.lit(""))
    if name.startswith("profile."):
        return F.coalesce(F.col(f"profile_{name.split('.', 1)[1]}").cast("string"), F.lit(""))
    return F.col(name)
